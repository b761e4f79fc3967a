"""Change-driven work as Structured Streaming: bursts that a quiet time ends, and idempotent upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quiet_sessions(events: DataFrame, gap: str = "60 seconds", late: str | None = None) -> DataFrame:
    """user_id, first_ts, last_ts, n of each burst. On a stream, ``late`` is the watermark; a burst comes out once quiet."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return out.select("user_id", "first_ts", "last_ts", "n")


def upsert_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``apply(batch, batch_id)`` on what is there and stops; applying a batch twice must give the same store, as it
    does when rows are replaced by path."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
