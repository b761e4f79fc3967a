"""Token ids as bit-packed shards: each id takes the fewest bits that the vocabulary needs.

A shard file is: a fixed head, blocks of ``block_tokens`` ids packed to ``bits`` bits each (little-endian, 64 ids in
``bits`` 64-bit words, so numpy packs and unpacks 64 lanes at a time), then an index: block offsets, document ids, their
null flags and document token ends, and last the index's own offset. A reader can seek to any block or document.

Writing: documents are dealt by ranges of doc_id (ties by a hash of the text), sorted, encoded whole by the library and
packed where they lie; each task streams blocks to files of at most ``shard_tokens`` ids, written under a name of the
attempt and renamed when whole, so a retried task replaces its own files and nothing else. A manifest table lists the
shards that count.

Defined cases: a null or empty text is a document of the end id alone; null ids sort first; repeated ids keep all their
rows; an empty table writes no shard. Ids never leave the tasks but in files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import Scratch
from palaver.llm.tokens import encoder

MAGIC = b"PLVBITS1"
_HEAD = struct.Struct("<8sBxxxII")
_TAIL = struct.Struct("<QQQQ")  # index offset, blocks, documents, tokens


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as little-endian fields of ``bits`` bits; the last group of 64 is padded with zeros."""
    n = -(-len(ids) // 64)
    v = np.zeros(n * 64, dtype=np.uint64)
    v[: len(ids)] = ids
    v = np.ascontiguousarray(v.reshape(n, 64).T)
    out = np.zeros((bits, n), dtype=np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        out[w] |= v[j] << np.uint64(s)
        if s + bits > 64:
            out[w + 1] |= v[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    words = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").reshape(-1, bits).T)
    out = np.empty((64, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        x = words[w] >> np.uint64(s)
        if s + bits > 64:
            x = x | (words[w + 1] << np.uint64(64 - s))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).ravel()[:count]


class ShardWriter:
    """Streams documents into one shard file."""

    def __init__(self, out: pa.NativeFile, bits: int, vocab_size: int, block_tokens: int) -> None:
        self.out, self.bits, self.block = out, bits, block_tokens
        out.write(_HEAD.pack(MAGIC, bits, vocab_size, block_tokens))
        self.at, self.offsets = _HEAD.size, [_HEAD.size]
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.open = np.zeros(0, dtype=np.uint32)
        self.tokens = self.n_docs = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.ends.append(self.tokens + np.cumsum(lens))
        self.tokens += int(lens.sum())
        self.n_docs += len(doc_ids)
        self.open = np.concatenate([self.open, ids])
        whole = len(self.open) // self.block
        for i in range(whole):
            self._put(self.open[i * self.block : (i + 1) * self.block])
        self.open = self.open[whole * self.block :].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if len(self.open):
            self._put(self.open)
        for x, kind in ((self.offsets, "<u8"), (np.concatenate(self.docs), "<i8"), (np.concatenate(self.nulls), "u1"), (np.concatenate(self.ends), "<u8")):
            self.out.write(np.asarray(x).astype(kind).tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.offsets) - 1, self.n_docs, self.tokens))
        self.out.close()


class ShardReader:
    """Random access to one shard: its index, any block, any document."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        magic, self.bits, self.vocab_size, self.block = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        size = file.size()
        index, self.n_blocks, self.n_docs, self.tokens = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        at = index
        arrays = []
        for count, kind in ((self.n_blocks + 1, "<u8"), (self.n_docs, "<i8"), (self.n_docs, "u1"), (self.n_docs, "<u8")):
            width = np.dtype(kind).itemsize
            arrays.append(np.frombuffer(self._read(at, count * width), dtype=kind))
            at += count * width
        self.offsets, self.doc_ids, self.nulls, ends = arrays
        self.ends = ends.astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """ids of blocks first..last, that one excluded."""
        data = self._read(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        # every block but the last is full, and a full block is a whole number of 64-id groups
        return unpack(data, min(last * self.block, self.tokens) - first * self.block, self.bits)

    def tokens_between(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, -(-end // self.block)
        return self.blocks(first, last)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens_between(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _uri(path: str) -> str:
    """Hadoop writes local paths as file:/x; Arrow wants file:///x or a plain path."""
    return re.sub("^file:/(?!/)", "file:///", path)


def write_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, block_tokens: int = 1 << 16, shard_tokens: int = 1 << 24) -> DataFrame:
    """Writes shards of all documents in ascending doc_id order; returns their manifest (also written, ``out_dir``/manifest):
    shard (order), path, n_docs, n_tokens, bytes."""
    if block_tokens % 64:
        raise ValueError("block_tokens must be a multiple of 64")
    spark, out_uri = docs.sparkSession, _uri(out_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, fewer_rules=True)
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = fs.FileSystem.from_uri(f"{out_uri}/shards")
        store.create_dir(root, recursive=True)
        made: list[tuple[str, str, int, int, int]] = []
        shard: ShardWriter | None = None
        names = ("", "")

        def close() -> None:
            shard.close()
            store.move(names[0], names[1])
            name = names[1].rpartition("/")[2]
            made.append((name, f"{out_uri}/shards/{name}", shard.n_docs, shard.tokens, shard.at))

        for b in batches:
            for at in range(0, len(b), 2048):
                x = b.slice(at, 2048)
                counts, ids = enc.encode(x.column(1))
                if not len(counts):
                    continue
                lens = counts + 1
                ends = np.cumsum(lens)
                whole = np.empty(int(ends[-1]), dtype=np.uint32)
                mask = np.ones(len(whole), dtype=bool)
                mask[ends - 1] = False
                whole[mask] = ids
                whole[ends - 1] = end_id
                if shard is None or shard.tokens >= shard_tokens:
                    if shard is not None:
                        close()
                    name = f"part-{part:06d}-{len(made):05d}.bin"
                    names = (f"{root}/.{name}.{attempt}", f"{root}/{name}")
                    shard = ShardWriter(store.open_output_stream(names[0]), bits, enc.vocab_size, block_tokens)
                null = x.column(0).is_null().to_numpy(zero_copy_only=False)
                shard.add(x.column(0).fill_null(0).to_numpy(zero_copy_only=False), null, lens, whole)
        if shard is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_tokens", "bytes"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    dealt.mapInArrow(run, "shard string, path string, n_docs long, n_tokens long, bytes long").write.parquet(f"{out_dir}/manifest")
    return spark.read.schema("shard string, path string, n_docs long, n_tokens long, bytes long").parquet(f"{out_dir}/manifest")


def read_digests(manifest: DataFrame, step_tokens: int = 1 << 22) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, block.

    The running start needs one row a shard, so its window is over the manifest only."""
    spark = manifest.sparkSession
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("shard", "path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as f:
                    s = ShardReader(f)
                    starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                    crc = np.zeros(s.n_docs, dtype=np.int64)
                    at = 0
                    while at < s.n_docs:  # some documents at a time
                        to = max(at + 1, int(np.searchsorted(s.ends, starts[at] + step_tokens, side="right")))
                        ids = s.tokens_between(int(starts[at]), int(s.ends[to - 1])).astype("<u4")
                        data, zero = memoryview(ids).cast("B"), int(starts[at])
                        for i in range(at, to):
                            crc[i] = zlib.crc32(data[4 * (int(starts[i]) - zero) : 4 * (int(s.ends[i]) - zero)])
                        at = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids, mask=s.nulls.astype(bool)), pa.array(starts + row["base"]), pa.array(s.ends - starts), pa.array(crc), pa.array([row["shard"]] * s.n_docs, pa.string()), pa.array(starts // s.block)],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"],
                    )

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, block long")


def encode_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None) -> DataFrame:
    """Writes the shards (below the shared folder unless told where) and returns what reading them back gives."""
    out_dir = out_dir or Scratch(docs.sparkSession, "shards").root
    return read_digests(write_shards(docs, out_dir, tokenizer_path, end_id))
