"""Hard negatives of anchors by product quantisation with stored residual norms.

Vectors are whole numbers, floor(scale * x), and a score is their inner product. Each vector has a code (its nearest
centroid in every pair of components, the codebooks being fitted on a bounded sample) and, for every pair, the norm of what
the centroid leaves. For an anchor, a table of its products with all centroids gives an estimate of a score by look-ups,
and |score - estimate| <= sum over pairs of |anchor's part| |residual's part|. A row takes part in a window only if the
estimate plus or minus this bound may place it there; what remains is scored exactly in whole numbers, so no estimate
decides a result and nothing is lost, however poor the codebooks are.

1. Positives: rows meet the anchors of their own label (groups of about ``group`` anchors, slices of ``slice_rows`` rows),
   as a stream that keeps the best few of each anchor. A label however large is many groups and slices.
2. Negatives: packed blocks of rows meet all groups of anchors; a stream keeps, for each anchor and positive, the best few
   inside the window of scores. Both are the anchors against all rows, in blocks; tasks emit a bounded number a window.

Defined cases: rows with a null vec_id, label or vector or a null or non-finite component take no part (non-finite also
once scaled); only vectors of one length have scores with each other, and empty ones score 0; rows that repeat a vec_id are
rows of their own (also as anchors), ties between them are alike in all that is returned; scores beyond 64 bits are
computed in full and count as the nearest 64-bit number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, shuffle_partitions

WIDTH, CENTROIDS = 2, 256
_CODED = "row long, vec_id long, label long, anchor boolean, dim int, vec binary, codes binary, norms binary"
_BLOCK = "block long, n int, dim int, row binary, vec_id binary, label binary, vec binary, codes binary, norms binary"
_POSITIVE = "arow long, vec_id long, score long"
_NEGATIVE = "arow long, place int, vec_id long, score long"
_ID = np.dtype(">i8")  # ids in binary columns: what F.hex of a long gives
_MOST = 1 << 63
_TABLES = 256  # anchors that meet a block of rows at a time


def subspaces(dim: int) -> int:
    return -(-dim // WIDTH)


def split(v: np.ndarray) -> np.ndarray:
    """n x dim as n x subspaces x WIDTH; the last is filled with zeros."""
    m = subspaces(v.shape[1])
    return np.pad(v, ((0, 0), (0, m * WIDTH - v.shape[1]))).reshape(len(v), m, WIDTH)


def fit_codebook(points: np.ndarray, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """CENTROIDS x WIDTH of n x WIDTH points by Lloyd's rounds from a seeded choice of points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    c = distinct[rng.permutation(len(distinct))[:CENTROIDS]]
    for _ in range(rounds if len(distinct) > CENTROIDS else 0):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=points[:, k], minlength=len(c)) for k in range(points.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.concatenate([c, np.repeat(c[:1], CENTROIDS - len(c), axis=0)])


def nearest(points: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - points[at : at + step] @ c.T, axis=1) for at in range(0, len(points), step)] or [np.zeros(0, dtype=np.int64)])


def codebooks(sample: DataFrame, most_lengths: int = 16) -> dict[int, np.ndarray]:
    """For each of the commonest lengths of a bounded sample: subspaces x CENTROIDS x WIDTH. A task fits one subspace of one
    length."""
    common = sample.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(most_lengths)
    pairs = sample.join(F.broadcast(common.select("dim")), F.size("v") == F.col("dim"), "left_semi")
    pairs = pairs.select(F.size("v").alias("dim"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / WIDTH).cast("int")), lambda k: F.slice("v", k * WIDTH + 1, F.lit(WIDTH)))).alias("sub", "x")).where("dim > 0")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.zeros((len(rows), WIDTH))
        for i, x in enumerate(rows["x"]):
            points[i, : len(x)] = x
        return pd.DataFrame({"dim": [key[0]], "sub": [key[1]], "c": [fit_codebook(points).tobytes()]})

    found: dict[int, dict[int, np.ndarray]] = {}
    for r in pairs.groupBy("dim", "sub").applyInPandas(fit, "dim int, sub int, c binary").collect():
        found.setdefault(r.dim, {})[r.sub] = np.frombuffer(r.c).reshape(CENTROIDS, WIDTH)
    return {dim: np.stack([subs[k] for k in range(subspaces(dim))]) for dim, subs in found.items()}


def book_of(books: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """A length that the sample missed has one centroid, zero: its bound is the vector's own norm."""
    return books[dim] if dim in books else np.zeros((subspaces(dim), CENTROIDS, WIDTH))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _encode(books: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat, lens = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                v = flat[ends[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                parts, book = split(v), book_of(books, int(dim))
                codes = np.stack([nearest(parts[:, k], book[k]) for k in range(len(book))], axis=1) if dim else np.zeros((len(at), 0), dtype=np.int64)
                left = parts - book[np.arange(len(book)), codes] if dim else parts
                norms = np.nextafter(np.sqrt((left**2).sum(axis=2)).astype(np.float32), np.float32(np.inf))
                x = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(np.full(len(at), dim, dtype=np.int32)), _binary(v), _binary(codes.astype(np.uint8)), _binary(norms)], ["row", "vec_id", "label", "anchor", "dim", "vec", "codes", "norms"])

    return run


def _packed(rows: int):
    """Coded rows as blocks of at most ``rows`` rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                for at in range(0, len(own), rows):
                    x = own.slice(at, rows)
                    row, vec_id, label = (x.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                    data = [*[i.astype(_ID).tobytes() for i in (row, vec_id, label)], *[b"".join(x.column(k).to_pylist()) for k in (5, 6, 7)]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(row[0])], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([int(dim)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], ["block", "n", "dim", "row", "vec_id", "label", "vec", "codes", "norms"])

    return run


class Vectors:
    """Some rows of one length."""

    def __init__(self, rows: list[dict], dim: int) -> None:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows), dtype=kind)

        self.row, self.vec_id, self.label = (joined(k, _ID).astype(np.int64) for k in ("row", "vec_id", "label"))
        n, m = len(self.row), subspaces(dim)
        self.vec = joined("vec", np.float64).reshape(n, dim)
        self.codes = joined("codes", np.uint8).reshape(n, m)
        self.norms = joined("norms", np.float32).reshape(n, m).astype(np.float64)
        self.largest = float(np.abs(self.vec).max(initial=0))


class Anchors(Vectors):
    """Anchors with their tables: product with every centroid, and the norm of every part."""

    def __init__(self, rows: list[dict], dim: int, book: np.ndarray) -> None:
        super().__init__(rows, dim)
        self.windows = [np.frombuffer(r["windows"] or b"", dtype=_ID).astype(np.int64).reshape(-1, 2) for r in rows]
        parts = split(self.vec)
        self.table = np.einsum("amw,mcw->mac", parts, book)
        self.parts = np.sqrt((parts**2).sum(axis=2))
        # rounding of the sums below, as a share of the largest terms
        self.slack = 1e-9 * (np.abs(self.table).max(axis=2, initial=0).sum(axis=0) + 1)

    def bounds(self, x: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, anchors x rows."""
        estimate = np.zeros((len(self.row), len(x.row)))
        for k in range(x.codes.shape[1]):
            estimate += np.take(self.table[k], x.codes[:, k], axis=1)
        wide = self.parts @ x.norms.T * (1 + 1e-9) + self.slack[:, None]
        low, high = np.clip(estimate - wide, -_MOST, _MOST), np.clip(estimate + wide, -_MOST, _MOST)
        if not np.isfinite(estimate).all():  # beyond doubles: no bound, exact scores tell
            low[np.isnan(low)], high[np.isnan(high)] = -_MOST, _MOST
        return low, high

    def scores(self, a: np.ndarray, b: np.ndarray, x: Vectors) -> np.ndarray:
        """Exact scores of the pairs (a, b): doubles where no sum can leave 53 bits, else whole numbers of any size."""
        dim = self.vec.shape[1]
        if self.largest * x.largest * max(dim, 1) < 2.0**53:
            out = np.empty(len(a), dtype=np.int64)
            for at in range(0, len(a), 100_000):
                i, j = a[at : at + 100_000], b[at : at + 100_000]
                out[at : at + len(i)] = np.einsum("pd,pd->p", self.vec[i], x.vec[j])
            return out
        whole = (sum(int(p) * int(q) for p, q in zip(self.vec[i], x.vec[j], strict=True)) for i, j in zip(a, b, strict=True))
        return np.array([min(max(s, -_MOST), _MOST - 1) for s in whole], dtype=np.int64)


class Best:
    """The best ``most`` (score, vec_id) of each window met so far."""

    def __init__(self, windows: int, most: int) -> None:
        self.most, self.floor = most, np.full(windows, -np.inf)
        self.at, self.score, self.vec_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(at):
            return
        at, score, vec_id = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.vec_id, vec_id])
        order = np.lexsort((vec_id, ~score, at))  # ~ turns the order of all 64-bit numbers round
        at, score, vec_id = at[order], score[order], vec_id[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.most
        self.at, self.score, self.vec_id = at[keep], score[keep], vec_id[keep]
        full = place == self.most - 1
        self.floor[at[full]] = score[full].astype(np.float64)


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """By row; -inf where there are fewer columns."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def below(x: np.ndarray) -> np.ndarray:
    """A float not above the whole number that was rounded to it."""
    return x - np.abs(x) * 1e-12


class Positives:
    """The best rows of an anchor's label, itself left out."""

    def __init__(self, anchors: Anchors, most: int) -> None:
        self.anchors, self.best = anchors, Best(len(anchors.row), most)

    def meet(self, x: Vectors) -> None:
        low, high = self.anchors.bounds(x)
        own = (self.anchors.row[:, None] == x.row[None, :]) | (self.anchors.label[:, None] != x.label[None, :])
        low[own] = -np.inf
        high[own] = -np.inf
        floor = np.maximum(kth_largest(low, self.best.most), below(self.best.floor))
        a, b = np.nonzero((high >= floor[:, None]) & ~own)
        self.best.add(a, self.anchors.scores(a, b, x), x.vec_id[b])

    def rows(self) -> list[list]:
        return [self.anchors.row[self.best.at].tolist(), self.best.vec_id.tolist(), self.best.score.tolist()]


class Negatives:
    """The best rows of other labels inside each window [low, high] of scores."""

    def __init__(self, anchors: Anchors, most: int) -> None:
        self.anchors = anchors
        self.of = np.repeat(np.arange(len(anchors.row)), [len(w) for w in anchors.windows])
        self.place = np.concatenate([np.arange(len(w)) for w in anchors.windows] or [np.zeros(0, dtype=np.int64)])
        self.limits = np.concatenate(anchors.windows) if anchors.windows else np.zeros((0, 2), dtype=np.int64)
        self.best = Best(len(self.of), most)

    def meet(self, x: Vectors) -> None:
        low, high = self.anchors.bounds(x)
        other = self.anchors.label[:, None] != x.label[None, :]
        for place in range(int(self.place.max(initial=-1)) + 1):  # windows of one anchor share its bounds
            w = np.flatnonzero(self.place == place)
            a, (least, most) = self.of[w], self.limits[w].astype(np.float64).T
            l, h = low[a], high[a]
            sure = np.where((l >= least[:, None]) & (h <= most[:, None]) & other[a], l, -np.inf)
            floor = np.maximum.reduce([below(least), below(self.best.floor[w]), kth_largest(sure, self.best.most)])
            i, j = np.nonzero((h >= floor[:, None]) & (l <= (most + np.abs(most) * 1e-12)[:, None]) & other[a])
            score = self.anchors.scores(a[i], j, x)
            inside = (score >= self.limits[w[i], 0]) & (score <= self.limits[w[i], 1])
            self.best.add(w[i[inside]], score[inside], x.vec_id[j[inside]])

    def rows(self) -> list[list]:
        at = self.best.at
        return [self.anchors.row[self.of[at]].tolist(), self.place[at].tolist(), self.best.vec_id.tolist(), self.best.score.tolist()]


def _cells(kind: type, most: int, books: dict[int, np.ndarray], schema: pa.Schema, block_rows: int):
    """Rows sorted by cell, anchors first: builds the anchors' tables, then streams the rows past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, held, n, work = None, [], [], 0, []

        def meet() -> None:
            nonlocal anchors, held, n, work
            book = book_of(books, now["dim"]) if anchors else None
            work += [kind(Anchors(anchors[at : at + _TABLES], now["dim"], book), most) for at in range(0, len(anchors), _TABLES)]
            if work and held:
                x = Vectors(held, now["dim"])
                for w in work:
                    w.meet(x)
            anchors, held, n = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal work
            if now is not None:
                meet()
            for w in work:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(w.rows(), schema, strict=True)], schema=schema)
            work = []

        for b in batches:
            for r in b.to_pylist():
                if now is None or r["cell"] != now["cell"]:
                    yield from close()
                    now = r
                if r["anchor"]:
                    anchors.append(r)
                    continue
                held.append(r)
                n += r["n"]
                if n >= block_rows:
                    meet()
        yield from close()

    return run


def _id(x: Column) -> Column:
    """A long as the 8 bytes of ``_ID``."""
    return F.to_binary(F.lpad(F.hex(x), 16, "0"), F.lit("hex"))


def _floor(x: Column) -> Column:
    """floor as a double: the built-in gives a long, which the largest doubles leave."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _count_to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _dealt(anchors: DataFrame, rows: DataFrame, *cell: str) -> DataFrame:
    """Anchors and rows that meet them, by cell, the anchors first."""
    both = anchors.withColumn("anchor", F.lit(True)).unionByName(rows.withColumn("anchor", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("cell", F.concat_ws("/", *cell, "dim"))
    return both.select("cell", "anchor", "n", "dim", "row", "vec_id", "label", "vec", "codes", "norms", "windows").repartition("cell").sortWithinPartitions("cell", F.desc("anchor"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    sample_rows: int = 8192,
    group: int = 1024,
    slice_rows: int = 1 << 16,
    block_rows: int = 2048,
    most_broadcast: int = 100_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label); ``is_anchor``
    is a condition on vec_id. A negative's score is ``window`` per cent of the positive's, both ends included. The
    codebooks are fitted on about ``sample_rows`` rows; every row is coded and met. Sizes of labels are broadcast while there
    are ``most_broadcast`` of them at most, and joined by a shuffle beyond."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where("vec_id is not null and label is not null and embedding is not null")
    scaled = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")), _floor(x * scale)))
    base = base.select("vec_id", "label", scaled.alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    books = codebooks(base.sample(min(1.0, sample_rows / max(1, base.count())), seed=11))
    numbered = base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "v")
    coded = scratch.write(numbered.mapInArrow(_encode(books), _CODED), "coded").withColumn("h", F.xxhash64("row"))
    fields = [F.lit(1).alias("n"), "dim", *[_id(F.col(c)).alias(c) for c in ("row", "vec_id", "label")], "vec", "codes", "norms"]

    # rows of a label meet its anchors
    counts = coded.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).where("anchors > 0")
    counts = scratch.write(counts, "labels")
    few = counts.count() <= most_broadcast
    counts = counts.select("label", "dim", F.ceil(F.col("anchors") / group).alias("parts"), F.ceil(F.col("rows") / slice_rows).alias("slices"))
    near = coded.join(F.broadcast(counts) if few else counts, ["label", "dim"]).withColumn("of", F.col("label"))
    own = near.where("anchor").select(F.pmod("h", "parts").alias("part"), _count_to(F.col("slices")).alias("slice"), "of", F.lit(None).cast("binary").alias("windows"), *fields)
    met = near.select(_count_to(F.col("parts")).alias("part"), F.pmod(F.xxhash64("row", F.lit(1)), "slices").alias("slice"), "of", *fields)
    schema = pa.schema([("arow", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = _dealt(own, met, "of", "part", "slice").mapInArrow(_cells(Positives, positives, books, schema, block_rows), _POSITIVE)
    order = Window.partitionBy("arow").orderBy(F.desc("score"), "vec_id")
    best = scratch.write(found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives), "positives")

    # the windows of an anchor, in the order of its positives, meet all rows
    whole = F.col("score").cast("decimal(38,0)")
    low, high = (_id(f(whole * w / 100).cast("long")) for f, w in ((F.ceil, window[0]), (F.floor, window[1])))
    windows = best.groupBy(F.col("arow").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", F.concat(low, high).alias("w")))).alias("w"))
    windows = windows.select("row", F.aggregate("w", F.to_binary(F.lit("")), lambda acc, x: F.concat(acc, x["w"])).alias("windows"))
    size = coded.agg(F.count_if("anchor").alias("anchors"), F.count("*").alias("rows")).first()
    parts = max(1, -(-size.anchors // group))
    slices = max(1, min(-(-size.rows // block_rows), -(-2 * shuffle_partitions(spark) // parts)))
    asking = coded.where("anchor").join(windows, "row").select(F.pmod("h", F.lit(parts)).alias("part"), _count_to(F.lit(slices)).alias("slice"), "windows", *fields)
    blocks = coded.drop("h").mapInArrow(_packed(block_rows), _BLOCK)
    met = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).withColumn("part", _count_to(F.lit(parts)))
    schema = pa.schema([("arow", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = _dealt(asking, met, "part", "slice").mapInArrow(_cells(Negatives, negatives, books, schema, block_rows), _NEGATIVE)
    order = Window.partitionBy("arow", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    ranked = ranked.select("arow", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = ranked.join(best.select("arow", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["arow", "place"])
    named = pairs.join(coded.where("anchor").select(F.col("row").alias("arow"), F.col("vec_id").alias("anchor_id")), "arow")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM s WHERE same),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE p.place <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
