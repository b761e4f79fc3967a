import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import authored, evidence, fold, hits, retrieval, semantic
from palaver.plans import store
from palaver.streaming.quiet import quiet_sessions, upsert_stream


def test_ordinals_replace_and_skip(spark):
    rows = [(1, 0, "assistant", "early", None), (1, 1, "user", "q", None), (1, 2, "assistant", "a", "m"), (1, 3, "system", "s", None), (1, 4, "assistant", "a2", "m"), (1, 5, "user", " ", None), (1, 6, "assistant", "b", None)]
    got = fold.ordinals(spark.createDataFrame(rows, "key int, turn int, role string, text string, message_id string")).orderBy("turn").collect()
    assert [(r.turn, r.ordinal) for r in got] == [(1, 1), (2, 2), (4, 2), (6, 3)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<system-reminder>x</system-reminder> my words [Image #1] <bash-stdout>open", "my words  <bash-stdout>open"),
        ("[Image: a\nb] kept [Imagery] [Image]", "[Image: a\nb] kept [Imagery]"),
        ("<command-name>open", None),
        (" \u00a0\n", None),
        (None, None),
        ("", None),
        ("Stop hook feedback: no", None),
        ("<command-name>/go</command-name><command-args> \n</command-args>", "/go"),
        ("<command-name>/clear</command-name>", None),
        ('<skill name="a" b>c</skill>\n d', "/a d"),
        ("<realtime_delegation>x<input> say </input>", "say"),
        ("<realtime_delegation>x", None),
        ("<bash-input>ls</bash-input>", "ls"),
    ],
)
def test_typed_text(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(authored.typed_text(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("input_", "state"), [("ch_" + "a" * 8, "ambiguous"), ("ch_" + "A" * 9, "found"), ("ch_" + "a" * 7, "invalid"), ("ch_" + "c" * 8, "not found"), ("ch_" + "g" * 8, "invalid"), ("ch_" + "a" * 33, "invalid"), ("", "invalid")]
)
def test_resolved(spark, input_, state):
    refs = spark.createDataFrame([("a" * 32,), ("a" * 8 + "b" * 24,), ("b" * 32,)], "ref string")
    row = retrieval.resolved(spark.createDataFrame([(input_,)], "input string"), refs).first()
    assert row.state == state and (row.ref is not None) == (state == "found")


def test_resolved_row_by_row(spark):
    refs = spark.createDataFrame([("a" * 32,)], "ref string")
    inputs = spark.createDataFrame([("ch_aaaaaaa",), ("ch_aaaaaaa",), ("ch_" + "a" * 9,), ("ch_" + "a" * 9,), (None,), (None,)], "input string")
    got = sorted(tuple(r)[1:3] for r in retrieval.resolved(inputs, refs).collect())
    assert got == [("found", 1)] * 2 + [("invalid", 0)] * 4


@pytest.mark.parametrize(("text", "most", "want"), [("aé", 2, "a"), ("aé", 3, "aé"), ("😀", 3, ""), ("", 0, ""), ("ab", 0, ""), (None, 4, None)])
def test_cut_bytes(spark, text, most, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.cut_bytes(F.col("t"), most)).first()[0] == want


def test_flat_and_grouped_order(spark):
    rows = [(1, 2, 1, "tool", 9.0), (1, 2, 1, "dialogue", 9.04), (1, 2, 3, "thinking", 9.06), (2, 1, 1, "dialogue", 0.0)]
    found = spark.createDataFrame(rows, "key int, rank int, ordinal int, source string, score double")
    assert [(r.key, r.ordinal, r.source) for r in hits.finalized(found, 3, flat=True).collect()] == [(2, 1, "dialogue"), (1, 1, "dialogue"), (1, 3, "thinking")]
    assert {(r.key, r.place) for r in hits.finalized(found, 2, 1).collect()} == {(1, 1), (2, 1)}
    assert {r.key for r in hits.finalized(found, 1).collect()} == {2}


@pytest.mark.parametrize(
    ("text", "role", "want"),
    [("All checks pass: just check", "assistant", ""), ("All checks pass: just check", "user", "All checks pass: just check"), ("/go on", "user", ""), ("┌─┐ ab │ words that stay here for long │", "user", "ab words that stay here for long"), ("const a = b - c - d => e", "user", ""), ("", "user", "")],
)
def test_turn_filter(spark, text, role, want):
    rows = spark.createDataFrame([(text, role)], "t string, r string")
    assert rows.select(semantic.filtered_turn(F.col("t"), F.col("r"))).first()[0] == want


def test_passages():
    assert semantic.pack_turns([(1, "a" * 1500), (2, "b" * 200), (3, "c" * 1000)]) == [(1, 2, "a" * 1500 + "\n\n" + "b" * 200), (2, 3, "b" * 200 + "\n\n" + "c" * 1000)]
    long = semantic.pack_turns([(1, "é" * 2000)])
    assert [len(t.encode()) <= semantic.TARGET_BYTES for _, _, t in long] == [True, True] and long[0][2][-150:] == long[1][2][:150]


def test_filter_turn(spark):
    rows = spark.createDataFrame([("keep <system-reminder>gone</system-reminder> ``` code ``` end <command-name>x ``` open",)], "t string")
    assert rows.select(semantic.filtered_turn(F.col("t"))).first()[0] == "keep end x"


def test_evidence(spark):
    text = "x" * 3000 + " error here and handling " + "y" * 3000 + " error"
    row = spark.createDataFrame([(text,), ("none",)], "t string").select(evidence.evidence(["error", "handling"], 10)("t").alias("e")).collect()
    assert "error here and handling" in row[0].e.text and len(row[0].e.ranges) == 2 and row[1].e.text is None
    assert evidence.clusters([(0, 5, 0), (20, 25, 1), (500, 505, 0)]) == [(0, 25), (500, 505)]


def test_partial_hits_only_where_strict_is_empty(spark):
    rows = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "red"), (2, 1, "red hen")], "key int, ordinal int, text_norm string")
    assert {(r.key, r.ordinal) for r in retrieval.message_hits(rows, ["red", "fox"]).collect()} == {(1, 1)}
    assert {(r.key, r.ordinal) for r in retrieval.message_hits(rows, ["red", "fox"], partial=True).collect()} == {(1, 1), (2, 1)}


def test_outline_steps(spark):
    rows = spark.createDataFrame([(1, i, "t") for i in range(1, 26)] + [(2, 1, "a  b")], "key int, ordinal int, text string")
    got = {(r.key, r.step): (r["first"], r["last"], r.chars) for r in retrieval.outline(rows).collect()}
    assert got == {(1, 0): (1, 10, 10), (1, 1): (11, 20, 10), (1, 2): (21, 25, 5), (2, 0): (1, 1, 4)}


def test_unique_prefixes(spark):
    random.seed(4)
    refs = ["".join(random.choice("01") for _ in range(16)) for _ in range(60)]
    got = {r.ref: r.short for r in retrieval.unique_prefixes(spark.createDataFrame([(r,) for r in refs], "ref string"), 3).collect()}
    for ref, short in got.items():
        assert ref.startswith(short) and sum(o.startswith(short) for o in set(refs)) == 1
        assert len(short) == 3 or sum(o.startswith(short[:-1]) for o in set(refs)) > 1


def test_refs_are_stable():
    assert retrieval.fnv128([]) == "6c62272e07bb014262b821756295c58d" and len(retrieval.fnv128(["a"])) == 32


def test_cache_roundtrip(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string").withColumn("text_hash", semantic.content_key(F.col("text")))
    empty = spark.createDataFrame([], "text_hash string, embedding array<float>")
    cache = semantic.embed_missing(rows, empty).cache()
    hits, missing = semantic.cache_split(rows, cache)
    assert cache.count() == 2 and hits.count() == 3 and missing.count() == 0


def test_batches_applied(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2), ("d", 5)], "path string, v int")
    fresh = spark.createDataFrame([("b", 3), ("c", 4)], "path string, v int")
    got = store.apply_batch(first, fresh, spark.createDataFrame([("a",)], "path string"))
    assert {tuple(r) for r in got.collect()} == {("b", 3), ("c", 4), ("d", 5)}


@pytest.mark.parametrize(("may_miss", "want"), [(False, "drop"), (True, "keep")])
def test_diff(spark, may_miss, want):
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "path string, mark string")
    base = spark.createDataFrame([("a", "1"), ("b", "1"), ("g", "1"), ("n", None)], "path string, mark string")
    assert {r.path: r.action for r in store.diff(scan, base, may_miss).collect()} == {"a": "keep", "b": "parse", "g": want, "n": "parse"}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, i * s) for s in (1, 100) for i in range(20)], "user_id int, at int").select("user_id", F.timestamp_seconds("at").alias("ts"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = upsert_stream(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sum(seen) == 40
    assert sum(r.n for r in quiet_sessions(rows).collect()) == 40
