"""Queries against their SQL where rows are newer than the searches' time: documents and conversations with keys far apart."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palaver import catalog
from palaver.plans.model import in_order

SF = "/root/testdata/sf0.001"
QUERIES = [
    "lex_browse_newest",
    "lex_explain_fields",
    "lex_score_documents",
    "lex_top_k",
    "hyb_fused_hits",
    "ret_finalized",
    "ret_global_hits",
    "idx_pair_search",
    "idx_search",
    "idx_search_top",
    "idx_ideographs",
]


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    out, con = str(tmp_path_factory.mktemp("late")), duckdb.connect()
    for t, key, apart in (("documents", "doc_id", 500), ("conversations", "conv_id", 7000), ("embeddings", "vec_id", 1)):
        con.execute(f"COPY (SELECT * REPLACE ({key} * {apart} AS {key}) FROM '{SF}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return out, con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_times_ahead(spark, late, name):
    folder, con = late
    sql = catalog.oracle_sql()[name]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = [tuple(map(plain, r)) for r in cur.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in catalog.queries()[name](spark, folder).collect()]
    if sql.rstrip().rpartition("\n")[2].startswith("ORDER BY") or sql.endswith("ORDER BY ts DESC"):
        assert got == want
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_order_of_shown_scores(spark):
    rows = spark.createDataFrame([(1, 10, 2.0000004), (2, 20, 2.0), (3, 20, 2.0000001), (4, 0, 2.000002)], "key int, ts int, score double")
    assert [r.key for r in in_order(rows).collect()] == [4, 2, 3, 1] and [r.key for r in in_order(rows, 2).collect()] == [4, 2]


def test_score_of_times_ahead(spark):
    from datetime import datetime, timedelta, timezone

    from palaver.operators import lexical

    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(now + timedelta(days=7),)], "ts timestamp").select(lexical.freshness(F.col("ts"), now), lexical.freshness(F.col("ts"), now, ahead=True))
    assert tuple(rows.first()) == (2.0, 4.0)
