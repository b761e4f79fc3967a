import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm.common import Scratch
from palaver.llm.components import connected_components
from palaver.llm.embeddings import near_duplicate_vectors
from palaver.llm.exact_dedup import ContentTable, exact_dedup
from palaver.llm.jaccard import JaccardJoin, near_duplicates

SCHEMA = "doc_id long, text string, rep string, n int, component string, uid int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], schema)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_table_probes_past_equal_hashes():
    t = ContentTable(4)
    assert [t.put(1, c)[0] for c in (b"a", b"b", b"a", b"c", b"d", b"b")] == [0, 1, 0, 2, 3, 1]


@pytest.mark.parametrize("limits", [{}, {"bucket_bytes": 50, "table_bytes": 300}])
def test_exact(spark, limits):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b "), (4, None), (5, ""), (6, " \n"), (7, "ab\x1c"), (8, "ä"), (9, "ab"), (None, "ab"), (8, "ä"), *[(100 + i, "hot text") for i in range(50)], (20, "x" * 100_000)]
    got = exact_dedup(frame(spark, rows), **limits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), float("inf") if i is None else i))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        own = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        assert (by[i].keep_id, by[i].group_size) == (min(own)[1], len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == roots({x for p in links for x in p}, links)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_jaccard(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = roots(ids, links)
    return {i: (len(sets[i]), top[i]) for i in ids}


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard(spark, hot):
    random.seed(hot)
    words = [f"w{i}" for i in range(400)]
    passage = random.choices(words, k=40)
    rows, i = [], 0
    for _ in range(40):
        base = random.choices(words, k=random.choice([2, 6, 9, 14, 40, 120]))
        if random.random() < 0.4:
            base += passage
        for _ in range(random.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                text[random.randrange(len(text))] = random.choice(words)
            if random.random() < 0.3:
                text.append(random.choice(words))
            rows.append((i, ("\n" if i % 3 else " ").join(text).upper() if i % 5 == 0 else " ".join(text)))
            i += 1
    base = random.choices(words, k=60)
    for _ in range(30):  # one group of near copies, chained
        base[random.randrange(60)] = random.choice(words)
        rows.append((i, " ".join(base)))
        i += 1
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "One"), (1005, "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JaccardJoin(frame(spark, rows), hot_df=hot).result().collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "z " * 5000)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("1", 2, 1), ("1", 2, 1), ("3", 1, 3), ("None", 2, 1)]


def brute_vectors(rows, threshold=0.98):
    import numpy as np

    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x, p) in enumerate(ok) for b, y, q in ok[k + 1 :] if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold]
    top = roots([r[0] for r in rows if r[0] is not None], links)
    return {i: (sum(i in p for p in links), top[i], top[i] == i) for i in top}


@pytest.mark.parametrize("block", [512, 4])
def test_vectors(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        v = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            w = v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1]) * 0.5
            rows.append((len(rows), [float(np.float32(x)) for x in w * rng.choice([1.0, 3.0])], int(c % 3)))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 0), (506, [1.0, 2.0], 0), (507, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, block=block).collect() if r.vec_id is not None}
    assert got == brute_vectors(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.text("ab \n", max_size=6)), max_size=30, unique_by=lambda r: r[0]))
def test_exact_any(spark, rows):
    got = exact_dedup(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == len({re.sub(r"\s", "", t) for _, t in rows}) and len(got) == len(rows)


def dealt_rows(spark, n, strangers, first_only):
    """Rows that a list of n near copies in one component, and some strangers, is dealt to blocks of 64 as."""
    join = JaccardJoin(frame(spark, []), block=64)
    entries = spark.range(n + strangers).selectExpr("7L AS key", "id AS place", "id AS set")
    join.sketches = entries.selectExpr("set", "cast(null AS binary) AS sketch")
    components = spark.range(n).selectExpr("id AS node", "0L AS component")
    got = join._dealt(entries, None if first_only else components, first_only)
    cells = got.groupBy("lo", "hi").agg({"set": "count"}).collect()
    return got.count(), max(c[2] for c in cells)


def test_a_cluster_is_dealt_in_proportion(spark):
    for first_only in (True, False):
        (small, _), (large, cell) = (dealt_rows(spark, n, 20, first_only) for n in (2000, 8000))
        assert large < 4.5 * small and large < 4 * 8000 and cell < 4 * 64 + 40


def test_blocks_of_components_meet_all_others(spark):
    """Every two sets of different components share a cell, on different sides of it or in one block."""
    join = JaccardJoin(frame(spark, []), block=8)
    rows = [(1, k, k) for k in range(60)] + [(2, k, k) for k in range(9)] + [(3, k, k) for k in range(30)]
    component = {k: 100 if k < 30 else 200 if k < 45 else k for k in range(60)}
    entries = spark.createDataFrame(rows, "key long, place long, set long")
    join.sketches = entries.selectExpr("set", "cast(null AS binary) AS sketch").distinct()
    got = join._dealt(entries, spark.createDataFrame(list(component.items()), "node long, component long"), False).collect()
    cells = {}
    for r in got:
        cells.setdefault((r.key, r.lo, r.hi), []).append((r.part, r.set))
    met = {(key, *sorted((a, b))) for (key, lo, hi), own in cells.items() for p, a in own for q, b in own if a != b and (lo == hi or p != q)}
    want = {(key, a, b) for key, _, a in rows for other, _, b in rows if key == other and a < b and component[a] != component[b]}
    assert want <= met and not [r for r in got if r.key == 3 and len({component[s] for _, s in cells[3, r.lo, r.hi]}) == 1]
