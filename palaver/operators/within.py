"""Search inside conversations, one or many at a time, in each of the four modes: every conversation gets its own best hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.mode import effective
from palaver.functions.query import parse
from palaver.operators import hits, matches

# Hits of each kind that a fusion looks at are so many times the hits asked for, within bounds.
DEPTH_FACTOR, DEPTH_LEAST, DEPTH_MOST = 8, 50, 1000


def depth(top: int) -> int:
    return min(max(top * DEPTH_FACTOR, DEPTH_LEAST), DEPTH_MOST)


def _first(rows: DataFrame, top: int, *order) -> DataFrame:
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return placed.where(F.col("place") <= top)


def lexical(segments: DataFrame, text: str, top: int) -> DataFrame:
    """(key, ordinal, kind, score, place): messages that match, each conversation's first ``top``."""
    rank = hits.source_rank(F.col("source"))
    dialogue_first = [rank.asc()] if parse(text).is_quoted_only else []
    found = _first(matches.match_messages(segments, text), top, *dialogue_first, F.desc("score"), F.asc("ordinal"), rank.asc(), F.asc("first"))
    return found.select("key", "ordinal", F.lit("lexical").alias("kind"), "score", "place")


def semantic(passages: DataFrame, top: int) -> DataFrame:
    """The same of passages (key, ordinal, score), one hit a message."""
    best = passages.groupBy("key", "ordinal").agg(F.max("score").alias("score"))
    return _first(best, top, F.desc("score"), F.asc("ordinal")).select("key", "ordinal", F.lit("semantic").alias("kind"), "score", "place")


def within(segments: DataFrame, text: str, top: int, passages: DataFrame | None = None, asked: str | None = None, configured: str | None = None, switch: bool | None = None) -> DataFrame:
    """(key, ordinal, kind, score, place) of the first ``top`` hits inside each conversation of ``segments``, in the mode that
    ``functions.mode`` gives; ``passages`` (key, ordinal, score) are its ranked passages. In a hybrid search a conversation
    is first in both rankings, so its messages are told apart by what found them and by their own scores."""
    mode = effective(text, asked, configured, switch)
    if mode in ("lexical", "exact"):
        return lexical(segments, text, top)
    if passages is None:
        raise ValueError(f"a {mode} search needs ranked passages")
    if mode == "semantic":
        return semantic(passages, top)
    words, meaning = lexical(segments, text, depth(top)), semantic(passages, depth(top))
    one = F.lit(1).cast("long").alias("rank")
    fused = hits.fused(words.select("key", one, "ordinal", "score"), meaning.select("key", "ordinal", "score"), meaning.select("key", one).distinct())
    return _first(fused, top, *hits.fused_order()).select("key", "ordinal", "kind", "score", "place")
