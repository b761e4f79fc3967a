"""Follow-the-regularised-leader (FTRL-proximal) logistic regression over hashed word n-grams.

Features: words of a text (runs of letters, single digits, runs of other signs; ASCII capitals folded, with a mark for
words in capitals), their n-grams and skip-grams, each hashed to 32 bits; a feature counts once a text. The model keeps
only non-zero weights, as sorted hashes and values, so it is small enough to send with the tasks whatever the corpus.

Training reads a bounded sample of labelled rows: rows whose hash of doc_id falls below sample_rows / labelled rows, so
about ``sample_rows`` of them whatever the size of the label table; ids with labels that differ are left out. Features seen
in fewer than ``min_df`` sampled texts are left out. The sample is dealt to shards and written once. Each round, the shards
run FTRL one text after another from the same state, in parallel tasks that read their own file; the changes of z and n are
averaged by feature, over the shards that met it, and form the next state. Scores are sparse dot products over whole texts;
of a long text the features come part by part, each part with the last words of the one before, so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, byte_slices, filled, freed, mix64, pieces_of, ragged_take, segments
from palaver.llm.prints import SPREAD, counted, spread

_TOKEN = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")


@dataclass(frozen=True)
class Grams:
    """Which features: n-grams up to ``ngram`` words, and pairs with 1 to ``skip`` words between them."""

    ngram: int = 2
    skip: int = 0


class Hasher:
    """Feature hashes of texts; remembers the words of pieces it has met, up to a bound."""

    def __init__(self, grams: Grams, max_pieces: int = 100_000) -> None:
        self.grams, self.max_pieces = grams, max_pieces
        self.memo: dict[str, tuple[int, ...]] = {}

    def _words(self, piece: str) -> tuple[int, ...]:
        import xxhash

        out = []
        for w in _TOKEN.findall(piece):
            if len(w) > 1 and w.isupper():
                out.append(xxhash.xxh64_intdigest("<capitals>"))
            out.append(xxhash.xxh64_intdigest(w.lower()))
        return tuple(out)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of its text)"""
        offsets, pieces, codes = pieces_of(texts)
        if len(self.memo) > self.max_pieces:
            self.memo.clear()
        memo, found = self.memo, []
        for p in pieces:
            w = memo.get(p)
            if w is None:
                w = memo[p] = self._words(p)
            found.append(w)
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((x for w in found for x in w), dtype=np.uint64, count=int(lens.sum()))
        starts = np.cumsum(lens) - lens
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        return ragged_take(flat, starts[codes], lens[codes]), np.repeat(row, lens[codes])

    def kinds(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(32-bit hashes, rows) for each kind of feature of words and their rows."""
        yield (mix64(h) >> np.uint64(32)).astype(np.uint32), row
        gram = h
        for n in range(2, self.grams.ngram + 1):
            if len(h) < n:
                break
            gram = mix64(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :])
            same = row[n - 1 :] == row[: len(row) - n + 1]
            yield (gram[same] >> np.uint64(32)).astype(np.uint32), row[n - 1 :][same]
        for gap in range(1, self.grams.skip + 1):
            if len(h) < gap + 2:
                break
            pair = mix64(h[: -gap - 1] * np.uint64(0xD6E8FEB86659FD93) + h[gap + 1 :] + np.uint64(gap))
            same = row[gap + 1 :] == row[: -gap - 1]
            yield (pair[same] >> np.uint64(32)).astype(np.uint32), row[gap + 1 :][same]

    def features(self, texts: pa.Array, part_bytes: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(32-bit hashes, rows) of all features, repeats included. A text over ``part_bytes`` goes in parts cut at white
        space; each part starts with the last words of the one before, as many as a feature can reach back."""
        if len(texts) != 1 or len(texts[0].as_py()) <= part_bytes:
            yield from self.kinds(*self.words(texts))
            return
        reach, carried = max(self.grams.ngram - 1, self.grams.skip + 1), np.zeros(0, dtype=np.uint64)
        for part in segments(texts[0].as_py(), part_bytes):
            h = np.concatenate([carried, self.words(pa.array([part]))[0]])
            yield from self.kinds(h, np.zeros(len(h), dtype=np.int64))
            carried = h[-reach:]


@dataclass
class Model:
    keys: np.ndarray  # sorted uint32
    weights: np.ndarray
    bias: float
    grams: Grams

    def scores(self, texts: pa.Array | pa.ChunkedArray, hasher: Hasher, batch_bytes: int = 2_000_000) -> np.ndarray:
        texts = filled(texts)
        near = np.zeros(1 << 20, dtype=bool)
        near[self.keys & np.uint32((1 << 20) - 1)] = True
        out = np.zeros(len(texts))
        for at, to in byte_slices(texts, batch_bytes):
            hits = [np.unique(r.astype(np.int64) * len(self.keys) + k) for k, r in (self._hits(h, r, near) for h, r in hasher.features(texts.slice(at, to - at), batch_bytes))]
            pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
            if len(self.keys):
                out[at:to] = np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=to - at)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))

    def _hits(self, hashes: np.ndarray, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = near[hashes & np.uint32((1 << 20) - 1)]
        hashes, rows = hashes[may], rows[may]
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        own = self.keys[at] == hashes if len(self.keys) else np.zeros(0, dtype=bool)
        return at[own], rows[own]


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the optimiser and of the sample. A text's loss weighs step / features, so a long text moves the
    margin no further than a short one."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.01
    step: float = 40.0
    rounds: int = 6
    shards: int = 4
    sample_rows: int = 12_000
    min_df: int = 5


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def _round(z: np.ndarray, n: np.ndarray, p: Ftrl):
    """FTRL over a shard's rows (shard, y, features), one by one; yields the changes of (z, n). The last coordinate is the
    bias, which has no penalty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, nn, w = z.copy(), n.copy(), _weights(z, n, p)
        bias, shard = len(z) - 1, None
        seen = np.zeros(len(z), dtype=bool)

        def rate(n_: np.ndarray, z_: np.ndarray, i: np.ndarray) -> np.ndarray:
            l1 = np.where(i == bias, 0.0, p.l1)
            return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((p.beta + np.sqrt(n_)) / p.alpha + p.l2))

        w[bias] = rate(nn[bias:], zz[bias:], np.array([bias]))[0]
        for b in batches:
            for shard, y, f in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                i = np.append(np.frombuffer(f, dtype=np.int32), bias)
                g = (1 / (1 + np.exp(-np.clip(w[i].sum(), -40, 40))) - y) * p.step / len(i)
                sigma = (np.sqrt(nn[i] + g * g) - np.sqrt(nn[i])) / p.alpha
                zz[i] += g - sigma * w[i]
                nn[i] += g * g
                w[i] = rate(nn[i], zz[i], i)
                seen[i] = True
        i = np.flatnonzero(seen)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i.astype(np.int32).tobytes()], pa.binary()), pa.array([np.stack([zz[i] - z[i], nn[i] - n[i]]).tobytes()], pa.binary())], ["shard", "i", "change"])

    return run


def _features_of(grams: Grams):
    """Of (y, text): y and the distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(grams)
        for b in batches:
            for at, to in byte_slices(filled(b.column(1)), 2_000_000):
                x = b.slice(at, to - at)
                pairs = np.unique(np.concatenate([np.unique(r.astype(np.int64) << 32 | h) for h, r in hasher.features(filled(x.column(1)))]))
                cut = np.searchsorted(pairs, np.arange(len(x) + 1, dtype=np.int64) << 32)
                low = (pairs & 0xFFFFFFFF).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([low[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["y", "f"])

    return run


def _spread_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from spread((np.frombuffer(f, dtype=np.uint32).astype(np.uint64) for b in batches for f in b.column(0).to_pylist()), 32)


def _known(keys: np.ndarray):
    """Of (y, f): y and the places in ``keys`` of the features that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for f in b.column(1).to_pylist():
                f = np.frombuffer(f, dtype=np.uint32)
                at = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
                kept.append(at[keys[at] == f].astype(np.int32).tobytes() if len(keys) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["y", "f"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str, grams: Grams, p: Ftrl) -> Model:
    """Learns label_col (0 or 1) of the rows in ``labels`` (doc_id, label_col) from texts of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ftrl")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    total = y.count()
    share = min(1.0, p.sample_rows / max(total, 1))
    # about sample_rows rows whatever the table's size: small enough to send to every task
    picked = F.broadcast(y.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("y", "text")
    sample = scratch.write(texts.mapInArrow(freed(_features_of(grams)), "y double, f binary"), "sample")
    often = counted(sample.select("f").mapInArrow(freed(_spread_features), SPREAD), 32, p.min_df)
    keys = np.sort(often.select("number").toArrow().column(0).to_numpy().astype(np.uint32))  # at most sample words x kinds / min_df
    # the shard and the order in it hang on what a text holds; a shard is one file
    rows = sample.mapInArrow(freed(_known(keys)), "y double, f binary").withColumn("order", F.xxhash64("f", "y", F.lit(29))).withColumn("shard", F.pmod("order", F.lit(p.shards)).cast("int"))
    rows.repartition(p.shards, "shard").write.partitionBy("shard").parquet(scratch.path("shards"))
    scratch.drop("sample")
    named = spark.read.schema("y double, f binary, order long, shard int").parquet(scratch.path("shards"))  # no file where no labelled text is there
    made = {r.shard for r in named.select("shard").distinct().collect()} if total else set()
    shards = [spark.read.schema("y double, f binary, order long").parquet(f"{scratch.path('shards')}/shard={k}").coalesce(1).sortWithinPartitions("order", "y").select(F.lit(k).alias("shard"), "y", "f") for k in sorted(made)]
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for _ in range(p.rounds if shards else 0):
        every = reduce(DataFrame.unionAll, shards).mapInArrow(freed(_round(z, n, p)), "shard int, i binary, change binary")
        change, met = np.zeros((2, len(z))), np.zeros(len(z))
        for row in sorted(every.toArrow().to_pylist(), key=lambda r: r["shard"]):  # a row for each shard
            i = np.frombuffer(row["i"], dtype=np.int32)
            change[:, i] += np.frombuffer(row["change"]).reshape(2, -1)
            met[i] += 1
        z += change[0] / np.maximum(met, 1)
        n += change[1] / np.maximum(met, 1)
    scratch.drop("shards")
    w = _weights(z, n, p)
    bias = -z[-1] / ((p.beta + np.sqrt(n[-1])) / p.alpha + p.l2)
    used = np.flatnonzero(w[:-1])
    return Model(keys[used], w[:-1][used], float(bias), grams)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(model.grams)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1), hasher))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), "doc_id long, score double")


def remainder(m: int):
    """crc32 of doc_id as text, mod m; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(m))
