import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, cell int, anchor string, h int, n int, part string, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z", 4) for r in rows], SCHEMA)


def plain(rows, every=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by comparing everything."""
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x * 256) for x in v):
            held.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for at, (i, v, label) in enumerate(held):
        if i % every:
            continue
        scored = [(min(max(sum(p * q for p, q in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j, k) for b, (j, w, k) in enumerate(held) if b != at and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 50 * ps <= 100 * x[0] <= 95 * ps][:3]
            out += [(i, p, rank + 1, j, ps, s) for rank, (s, j, _) in enumerate(near)]
    return sorted(out)


def vectors(n, dim, labels, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim))
    of = rng.integers(0, labels, n)
    x = centres[of] * 0.5 + rng.standard_normal((n, dim)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, of))]


@pytest.mark.parametrize("limits", [{}, {"group": 3, "slice_rows": 20, "block_rows": 7, "sample_rows": 30}])
@pytest.mark.parametrize("dim", [7, 16])
def test_equal_to_brute_force(spark, dim, limits):
    rows = vectors(240, dim, 4, dim)
    rows += [(300 + i, rows[0][1], 1) for i in range(60)]  # one vector many times
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **limits)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_defined_cases(spark):
    rows = vectors(60, 4, 2, 1)
    rows += [(500, [1.0, 0.0], 0), (501, [0.9, 0.1], 0), (505, [0.8, 0.1], 1), (510, [], 0), (511, [], 0), (512, [], 1)]  # other lengths
    rows += [(None, [1.0] * 4, 0), (100, None, 0), (105, [1.0, None, 0.0, 0.0], 0), (110, [float("nan")] * 4, 0), (115, [float("inf"), 0.0, 0.0, 0.0], 1), (120, [1.0] * 4, None)]
    rows += [(5, rows[5][1], rows[5][2]), (7, rows[8][1], rows[8][2])]  # repeated ids
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0


def test_scores_beyond_doubles_and_longs(spark):
    random.seed(3)
    rows = [(i, [random.uniform(-1, 1) * 10.0 ** random.choice([3, 8, 14]) for _ in range(6)], i % 3) for i in range(60)]
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    v = np.floor(rng.standard_normal((300, 8)) * 100)
    book = np.stack([hn.fit_codebook(x) for x in hn.split(v[:100]).transpose(1, 0, 2)])
    codes = np.stack([hn.nearest(hn.split(v)[:, k], book[k]) for k in range(4)], axis=1)
    left = np.sqrt(((hn.split(v) - book[np.arange(4), codes]) ** 2).sum(axis=2)).astype(np.float32)
    ids = np.arange(300).astype(hn._ID)
    rows = [{"row": ids[i].tobytes(), "vec_id": ids[i].tobytes(), "label": ids[i].tobytes(), "vec": v[i].tobytes(), "codes": codes[i].astype(np.uint8).tobytes(), "norms": np.nextafter(left[i], np.float32(np.inf)).tobytes(), "windows": None} for i in range(300)]
    anchors = hn.Anchors(rows[:40], 8, book)
    low, high = anchors.bounds(hn.Vectors(rows, 8))
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < exact.std()  # they tell rows apart


def test_query_is_its_sql_on_a_hot_label(spark, tmp_path):
    import duckdb

    from palaver.llm import queries

    rows = [(i, v, 0 if i % 3 else k) for i, v, k in vectors(400, 8, 10, 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(queries.ORACLES["op11_hard_negatives"]).fetchall())
