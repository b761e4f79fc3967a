import random

from test_dedup import brute_jaccard

from palaver.llm.jaccard import JaccardJoin


def test_prefixes_keep_one_order(spark, monkeypatch):
    """Shingles that only the lists show as frequent: sets that are not in these lists take the new order too."""
    rng = random.Random(5)
    by_role = [[] for _ in range(7)]
    for g in range(60):
        block = [f"b{g}x{i}" for i in range(30)]
        light = block + [f"o{g}x{i}" for i in range(10)]
        texts = [light, light + [f"e{g}x{i}" for i in range(4)]]
        texts += [[f"f{rng.random()}" for _ in range(30)] + block + [f"f{rng.random()}" for _ in range(30)] for _ in range(5)]
        for role, words in enumerate(texts):
            by_role[role].append((g * 7 + role, " ".join(words)))
    rows = [r for role in by_role for r in role]
    # a partition holds one row of each group, so that the first count finds nothing frequent
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 7), "doc_id long, text string")
    monkeypatch.setattr(JaccardJoin, "_boundary", lambda self: 48)
    join = JaccardJoin(df, hot_df=3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.result().collect()}
    assert len(join.hot)
    assert got == brute_jaccard(rows)
