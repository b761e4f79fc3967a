"""Tables kept below the folder that driver and executors share: written once in a session, read by many queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, ...], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def mark(spark: SparkSession, path: str) -> str:
    """Files, bytes and newest time below a path: another mark when the source is written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    n = size = newest = 0
    while files.hasNext():
        f = files.next()
        n, size, newest = n + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return f"{n}-{size}-{newest}"


def stored_path(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` makes from the table at ``source``, made the first time in a session and again when the source
    has changed. A path is known only when its tables are whole, so a failed write is begun anew elsewhere."""
    key = (spark.sparkContext.applicationId, name, source, mark(spark, source))
    if key not in _PATHS:
        path = f"{shared_folder(spark)}/palaver-{name}-{uuid.uuid4().hex[:12]}"
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def known_path(spark: SparkSession, name: str, source: str) -> str | None:
    """The path of what a session has stored of the table at ``source`` as it is now, if anything."""
    return _PATHS.get((spark.sparkContext.applicationId, name, source, mark(spark, source)))


def stored(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> DataFrame:
    """The one table that ``write`` makes, see ``stored_path``."""
    return spark.read.parquet(stored_path(spark, name, source, write))
