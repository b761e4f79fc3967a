"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Codes. A unit vector x is turned by seeded random rotations; the signs of its coordinates are its code, and for each
rotation f = sum |coordinate| / sqrt(d), the product of x with its own code direction, is stored beside it. For another
unit vector y, <code of x, turned y> / (sqrt(d) f) estimates <x, y> without bias, with an error below
``confidence`` sqrt((1 - f^2) / (f^2 (d - 1) rotations)) but for a probability that falls with exp(-confidence^2 / 2).
A pair is computed exactly, in double precision, only if estimate plus bound reaches the threshold; estimates never
decide a link.

Candidates. Pairs are looked for where ``band_bits`` bits of the codes agree in one of ``bands`` bands. At a cosine of
0.98 two vectors differ in a bit with probability 0.064, so a band of 16 agrees with 0.35 and all 32 disagree with
1.2e-6. Band keys travel without vectors; keys that occur once go, and only the rest meet their vectors. Groups larger
than ``block`` are dealt in pairs of blocks, so no group meets in one task, and there is no cap. A pair counts in the
first band it agrees in, only; tasks return sums and star edges, never pairs.

Equal vectors of a label form one class with a count first. Defined cases: null, empty or zero vectors, vectors with
null, infinite or NaN components, null labels and null ids link with nothing; vectors of other lengths never link; an
empty table gives an empty result; other columns are not read. vec_id is taken as an identity: rows that repeat it with
the same vector and label are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch
from palaver.llm.components import connected_components

_CODED = "rep long, label long, dim int, copies long, vec binary, code binary, factors binary, bands array<long>"
_FOUND = "rep long, n_add long, root long"


class Rotations:
    """Seeded random rotations of each dimension met."""

    def __init__(self, bits: int, seed: int) -> None:
        self.bits, self.seed = bits, seed
        self.made: dict[int, np.ndarray] = {}

    def of(self, dim: int) -> np.ndarray:
        """dim x (rotations * dim), at least ``bits`` columns."""
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            turns = []
            for _ in range(-(-self.bits // dim)):
                q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
                turns.append(q * np.sign(np.diag(r)))
            self.made[dim] = np.hstack(turns)
        return self.made[dim]


def _encode(rotations: Rotations, bands: int, band_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = np.array([len(v) for v in b.column(3).to_pylist()])
            for dim in np.unique(lens):
                x = b.filter(pa.array(lens == dim))
                v = np.array(x.column(3).to_pylist(), dtype=np.float64)
                unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
                turned = unit @ rotations.of(int(dim))
                n = turned.shape[1] // int(dim)
                factors = (np.abs(turned).reshape(len(v), n, int(dim)).sum(axis=2) / np.sqrt(dim)).astype(np.float32)
                code = np.packbits(turned >= 0, axis=1)
                bits = (turned[:, : bands * band_bits] >= 0).reshape(len(v), bands, band_bits)
                key = (bits * (1 << np.arange(band_bits, dtype=np.int64))).sum(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [x.column(0), x.column(1), pa.array(np.full(len(v), dim, dtype=np.int32)), x.column(2), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([f.tobytes() for f in factors], pa.binary()), pa.array(key.tolist(), pa.list_(pa.int64()))],
                    ["rep", "label", "dim", "copies", "vec", "code", "factors", "bands"],
                )

    return run


class PairScan:
    """Pairs inside a group (or between its two blocks): estimate, bound, exact product; sums and stars come out."""

    def __init__(self, rotations: Rotations, bands: int, band_bits: int, threshold: float, confidence: float) -> None:
        self.rotations, self.bands, self.width, self.threshold, self.confidence = rotations, bands, band_bits, threshold, confidence

    def pairs(self, i: np.ndarray, j: np.ndarray, g: dict[str, np.ndarray], band: int) -> np.ndarray:
        """Which of the pairs (i, j) link and agree in no band before this one."""
        dim = g["vec"].shape[1]
        ok = np.ones(len(i), dtype=bool)
        if band:
            ok = ~(g["keys"][i, :band] == g["keys"][j, :band]).any(axis=1)
        at = np.flatnonzero(ok)
        if not len(at):
            return ok
        ii, jj = i[at], j[at]
        # estimate by the code of i and the turned j, rotation by rotation
        turned = g["turned"][jj].reshape(len(jj), -1, dim)
        signs = g["signs"][ii].reshape(len(ii), -1, dim)
        f = g["factors"][ii].astype(np.float64)
        estimate = (np.einsum("pnd,pnd->pn", signs, turned) / (np.sqrt(dim) * f)).mean(axis=1)
        bound = self.confidence * np.sqrt(((1 - np.minimum(f, 1) ** 2) / (f**2 * max(dim - 1, 1))).mean(axis=1) / f.shape[1])
        near = estimate + bound >= self.threshold
        at, ii, jj = at[near], ii[near], jj[near]
        linked = np.zeros(len(i), dtype=bool)
        linked[at[np.einsum("pd,pd->p", g["vec"][ii], g["vec"][jj]) >= self.threshold]] = True
        return linked

    def group(self, rows: dict[str, np.ndarray], cross: bool, band: int, step: int = 50_000) -> list[tuple[int, int, int]]:
        """(rep, linked copies, root) of the rows with a link."""
        m = len(rows["rep"])
        first = rows["part"] == rows["part"].min()
        if cross:
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        else:
            i, j = np.triu_indices(m, 1)
        add, root = np.zeros(m, dtype=np.int64), np.arange(m)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(i), step):
            own = self.pairs(i[at : at + step], j[at : at + step], rows, band)
            x, y = i[at : at + step][own], j[at : at + step][own]
            np.add.at(add, x, rows["copies"][y])
            np.add.at(add, y, rows["copies"][x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        return [(int(rows["rep"][k]), int(add[k]), int(rows["rep"][top(k)])) for k in np.flatnonzero(add)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, lo, hi): bucket, lo, hi, part, band, rep, label, dim, copies, vec, code, factors."""
        held: list[dict] = []
        out: list[tuple[int, int, int]] = []
        for b in batches:
            for row in b.to_pylist():
                if held and (row["bucket"], row["lo"], row["hi"]) != (held[0]["bucket"], held[0]["lo"], held[0]["hi"]):
                    out += self._close(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "n_add", "root"])
                out = []
        out = self._close(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "n_add", "root"])

    def _close(self, held: list[dict]) -> list[tuple[int, int, int]]:
        cross = held[0]["lo"] != held[0]["hi"]
        if len(held) < 2 or (cross and len({r["part"] for r in held}) < 2):
            return []
        kinds: dict[tuple, list[dict]] = {}
        for r in held:  # a bucket is a hash: only rows of one label, length and band are a group
            kinds.setdefault((r["label"], r["dim"], r["band"]), []).append(r)
        out = []
        for (_, dim, band), rows in kinds.items():
            if len(rows) < 2 or (cross and len({r["part"] for r in rows}) < 2):
                continue
            g = {k: np.array([r[k] for r in rows], dtype=np.int64) for k in ("rep", "copies", "part")}
            g["vec"] = np.frombuffer(b"".join(r["vec"] for r in rows), dtype=np.float64).reshape(len(rows), dim)
            g["factors"] = np.frombuffer(b"".join(r["factors"] for r in rows), dtype=np.float32).reshape(len(rows), -1)[:, :2]
            bits = np.unpackbits(np.frombuffer(b"".join(r["code"] for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)
            n = g["factors"].shape[1] * dim
            g["signs"] = bits[:, :n].astype(np.float64) * 2 - 1
            g["turned"] = g["vec"] @ self.rotations.of(dim)[:, :n]
            g["keys"] = np.packbits(bits[:, : self.bands * self.width].reshape(len(rows), self.bands, self.width), axis=2).astype(np.int64) @ (256 ** np.arange(-(-self.width // 8)))
            out += self.group(g, cross, band)
        return out


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, bands: int = 32, band_bits: int = 16, block: int = 512, confidence: float = 5.0, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rotations = Rotations(bands * band_bits, seed)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    base = base.withColumn("valid", valid)
    classes = base.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a class goes by its own number, which is fixed once the table is written
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    coded = scratch.write(classes.select("rep", "label", "copies", "embedding").mapInArrow(_encode(rotations, bands, band_bits), _CODED), "codes")

    light = coded.select("rep", "label", "dim", F.posexplode("bands").alias("band", "key")).withColumn("bucket", F.xxhash64("label", "dim", "band", "key")).select("bucket", "band", "rep", "label")
    several = light.groupBy("bucket").count().where("count > 1")
    active = light.join(several, "bucket").withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    active = active.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), "parts").cast("int"))
    active = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    active = active.select("bucket", "band", "rep", "label", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    full = active.join(coded.select("rep", "dim", "copies", "vec", "code", "factors"), "rep")
    scan = PairScan(rotations, bands, band_bits, threshold, confidence)
    found = full.select("bucket", "lo", "hi", "part", "band", "rep", "label", "dim", "copies", "vec", "code", "factors").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(scan, _FOUND)
    found = scratch.write(found, "found")
    links = found.groupBy("rep").agg(F.sum("n_add").alias("n_add"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "rep")
    least = classes.select("rep", "least").join(components, "rep").groupBy("component").agg(F.min("least").alias("first"))
    components = components.join(least, "component").select("rep", F.col("first").alias("component"))
    placed = classes.join(links, "rep", "left").join(components, "rep", "left").select("label", "embedding", "copies", "n_add", F.coalesce("component", "least").alias("component"))
    rows = base.where("valid").join(placed, ["label", "embedding"], "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("n_add", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"))
    rows = rows.unionByName(base.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
