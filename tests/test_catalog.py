"""Every query of the catalogue against its DuckDB counterpart on the smallest tables."""

import importlib
from decimal import Decimal

import duckdb
import pytest

from palaver import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_entry_point(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
