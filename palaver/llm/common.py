"""Shared helpers of the corpus operators: written scratch tables, byte-balanced Arrow batches, ragged gathers.

Intermediate results are cut with tables written below ``spark.checkpoint.dir``, the folder that the driver and every
executor share, so a lost executor costs a retry and never a result.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and 0x09-0x0D.
WHITE = b" \t\n\x0b\x0c\r"
_WHITE_RE = re.compile(r"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one operator run below the shared folder; ``drop`` frees those that nothing reads any more, and ``together``
    all that were begun inside it."""

    open_: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/palaver-{name}-{uuid.uuid4().hex[:12]}"
        Scratch.open_.append(self)

    @classmethod
    @contextmanager
    def together(cls) -> Iterator[None]:
        before, cls.open_ = cls.open_, []
        try:
            yield
        finally:
            for x in cls.open_:
                x.drop("")
            cls.open_ = before

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, most: int = 8_000_000) -> None:
    """From now on the session's Arrow batches hold about ``most`` bytes, unless it has a bound of its own; results are often
    computed after an operator has returned, so this setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def release() -> None:
    """Gives the memory that this process has freed back to the system: Arrow's pool, and the C heap where it is glibc's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that ends with ``release``: a worker stays for later tasks, and would hold on to what this one has
    freed while other stages need it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(docs: DataFrame) -> DataFrame:
    """Rows as they are read where that is work for every core, else dealt evenly: a file of one row group is one task, however
    large it is. The count reads no column."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return docs if tasks >= cores else docs.repartition(cores)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], column.type)
    return pc.fill_null(column, "") if column.null_count else column


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def segments(text: str, most: int) -> Iterator[str]:
    """A long text in parts of about ``most`` characters, each ending at white space (a word is never cut)."""
    at = 0
    while len(text) - at > most:
        found = _WHITE_RE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space of a string array: (list offsets, distinct words, code of each word)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = flat.dictionary_encode()
    return offsets - offsets[0], coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged_take(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lens[i]] for all i, joined."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i] : offsets[i + 1]]; empty segments give 0."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixer (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
