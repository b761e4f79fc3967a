"""The stored index against the scan, incremental work, file lists."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palaver.functions.mode import effective
from palaver.operators import fold, lexical, retrieval, semantic, termindex
from palaver.plans.stored import stored
from palaver.sources import sessions

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
TEXTS = ["A red kite over the harbour", "harbour-kite: Red_Kite9 again, kites", "the Kite stood still", "漢字かな harbour", "", None, "donaudampfschifffahrtsgesellschaftskapitän kite", "kitesurf 9lives RED"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, NOW.replace(tzinfo=None), None, None, "bay" if i % 2 else "kite-club", t) for i, t in enumerate(TEXTS)]
    return lexical.prepare(spark.createDataFrame(rows, "key int, ts timestamp, title string, summary string, project string, body string")).cache()


@pytest.mark.parametrize(
    "text", ["kite", "red kite", "harbour club", '"Red_Kite"', '"the kite" still', "donaudampfschifffahrtsgesellschaftskap", "字", "kite9", '"9lives"', "", "nothing", '"-kite"']
)
def test_index_equals_scan(spark, docs, tmp_path, text):
    termindex.write_index(docs, str(tmp_path / "i"), 3, termindex.SEARCHED)
    index = spark.read.parquet(str(tmp_path / "i"))
    got, want = (sorted((r.key, round(r.score, 9)) for r in x.collect()) for x in (termindex.search(index, docs, text, NOW), lexical.search(docs, text, NOW)))
    assert got == want


def test_index_reads_a_range(spark, docs, tmp_path):
    termindex.write_index(docs, str(tmp_path / "i"), 3, termindex.SEARCHED)
    plan = termindex.prefix_tf(spark.read.parquet(str(tmp_path / "i")), "kite")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,kite)" in plan and "LessThan(term,kitf)" in plan


def test_short_prefixes(spark):
    index = spark.createDataFrame([("ab", 1, 8), ("ac", 1, 8), ("é", 1, 1), ("aé", 2, 3)], "term string, key int, tf int")
    assert {tuple(r) for r in termindex.short_prefixes(index).collect()} == {("a", 1, 10), ("ab", 1, 8), ("ac", 1, 8), ("é", 1, 1), ("a", 2, 3)}


def test_stored_once(spark, tmp_path):
    calls = []

    def write(path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("lost")
        spark.range(3).write.parquet(path)

    with pytest.raises(OSError):
        stored(spark, "t", str(tmp_path), write)
    assert [stored(spark, "t", str(tmp_path), write).count() for _ in range(2)] == [3, 3] and len(set(calls)) == 2


def test_core_and_matrix(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    assert semantic.core(rows, 2).count() == 2
    with pytest.raises(ValueError):
        semantic.core(rows, 1)
    cache = [("k", [1.0, 2.0]), ("k", [1.0, 3.0]), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("short", [1.0]), ("none", None), ("part", [None, 1.0])]
    got = semantic.matrix(spark.createDataFrame(cache, "text_hash string, embedding array<float>"), 2).collect()
    assert [(r.text_hash, r.embedding) for r in got] == [("k", [1.0, 3.0])]


def test_files(spark):
    rows = [("b", "1", 1, "y"), ("a", "1", 0, "x"), ("c", None, 0, "x"), ("d", None, 0, "x"), ("c", None, 1, "z")]
    got = sessions.one_per_file(spark.createDataFrame(rows, "path string, file_id string, root int, source string")).collect()
    assert {(r.path, r.source, tuple(r.also)) for r in got} == {("a", "x", ("y",)), ("c", "x", ("z",)), ("d", "x", ())}
    names = spark.createDataFrame([("/x/agent-acompact-1.jsonl",), ("agent-1.jsonl",), ("/agent-/s.jsonl",), ("s.txt",)], "p string")
    assert [r[0] for r in names.select(sessions.file_kind(F.col("p"))).collect()] == ["internal", "agent", "session", "other"]


def test_finished(spark):
    rows = spark.createDataFrame([(1, 2, "w"), (2, 0, "v"), (3, 1, "u")], "key int, message_count int, own_text string")
    flags = spark.createDataFrame([(1, True, None, None), (3, None, None, True)], "key int, child boolean, automated boolean, clear_only boolean")
    got = {r.key: (r.own_text, r.embedded, r.skipped) for r in fold.finished(rows, flags).collect()}
    assert got == {1: ("", False, None), 2: ("v", True, "empty"), 3: ("u", True, "clear only")}


def test_match_steps_alone(spark):
    lines = spark.createDataFrame([(1, 4, "The End"), (1, 5, None), (2, 1, "x")], "key int, line int, body string")
    assert [tuple(r) for r in retrieval.match_steps(lines, "the end").collect()] == [(1, 4, 4, 4)]


@pytest.mark.parametrize(
    ("args", "want"), [(('"a b"', "semantic"), "exact"), (("a", "hybrid", "semantic"), "hybrid"), (("a", None, "semantic", False), "semantic"), (("a", None, None, True), "semantic"), (("a", None, None, False), "lexical"), (("",), "lexical")]
)
def test_modes(args, want):
    assert effective(*args) == want
