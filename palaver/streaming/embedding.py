"""Embedding in the background: session files as a stream, newest first, whose new texts are embedded within a budget.

A micro-batch is a page of files. Its distinct texts that the store lacks are embedded and written under the number of the
batch, so a batch that runs again replaces its own rows and nothing else; what is stored is known by the hash of the text.
The stream ends when everything is there, when the budget is full, or when it is told to stop, and goes on from its
checkpoint the next time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import semantic

# Fixed values of the job: files a page, texts kept at most.
PAGE, MOST_TEXTS = 64, 45_000
STORED = "text_hash string, embedding array<float>, batch long"


def session_stream(spark: SparkSession, root: str, pattern: str = "*.jsonl", page: int = PAGE, max_age: str | None = None) -> DataFrame:
    """path, mtime, value of the lines of new files below a root, the newest files first; ``max_age`` (``24h``) leaves out files
    that are older than the newest by more."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("latestFirst", "true").option("maxFilesPerTrigger", page)
    reader = reader.option("maxFileAge", max_age) if max_age else reader
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What is embedded: text_hash, embedding, batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(folder)


def embed_batch(folder: str, most: int = MOST_TEXTS, embed: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """What to do with a batch (text): embeds and stores the texts that are missing, as many as the budget leaves."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = stored(spark, folder).where(F.col("batch") != number)
        left = most - others.count()
        if left <= 0:
            return
        texts = batch.where("text is not null").select("text", semantic.content_key(F.col("text")).alias("text_hash")).dropDuplicates(["text_hash"])
        missing = texts.join(others.select("text_hash"), "text_hash", "left_anti").orderBy("text_hash").limit(left)
        made = semantic.embed_missing(missing, spark.createDataFrame([], "text_hash string, embedding array<float>"), *([embed] if embed else []))
        made.select("text_hash", "embedding").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run


def embed_stream(passages: DataFrame, folder: str, checkpoint: str, most: int = MOST_TEXTS, stop: Callable[[], bool] | None = None, embed: Callable | None = None, poll_seconds: float = 0.2) -> bool:
    """Runs a stream of (text) to its end or until ``stop`` says so; whether it came to its end. Started again with the same
    checkpoint it goes on where it was, to the same table."""
    query = passages.writeStream.foreachBatch(embed_batch(folder, most, embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive:
        if stop and stop():
            query.stop()
            return False
        time.sleep(poll_seconds)
    if query.exception():
        raise query.exception()
    return True
