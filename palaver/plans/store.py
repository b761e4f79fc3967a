"""The store: diffs of a scan against what is stored, batches applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(scan: DataFrame, base: DataFrame, may_miss: bool = False) -> DataFrame:
    """(path, action) of two (path, mark) states: add, keep, parse, drop; an incomplete scan drops nothing, and a null mark
    (unknown state) is parsed again."""
    both = scan.select("path", F.col("mark").alias("new"), F.lit(True).alias("s")).join(base.select("path", F.col("mark").alias("old"), F.lit(True).alias("b")), "path", "full_outer")
    gone = F.lit("keep" if may_miss else "drop")
    action = F.when(F.col("b").isNull(), "add").when(F.col("s").isNull(), gone).when(F.col("new") == F.col("old"), "keep").otherwise("parse")
    return both.select("path", action.alias("action"))


def apply_batch(rows: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows with those of ``fresh`` in place of theirs and without ``gone``, by path."""
    out = rows.join(fresh.select("path").distinct(), "path", "left_anti").join(gone.select("path").distinct(), "path", "left_anti")
    return out.unionByName(fresh)
