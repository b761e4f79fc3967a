"""Subagents' files, frames of texts, references, and the embedding stream."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.operators import retrieval, semantic
from palaver.sources import sidecars
from palaver.streaming import embedding

METAS = [
    ({"agentType": "x", "description": " d "}, "child", "x: d"), ({"agentType": "x"}, "child", "x"), ({"description": "d"}, "child", "d"), ({}, "child", None),
    ({"isFork": True, "description": "q", "agentType": "x"}, "branch", "q"), ({"isFork": True, "agentType": "x"}, "branch", None), ({"isFork": True, "toolUseId": "t", "agentType": "x"}, "child", "x"),
    ({"agentType": 5, "description": "d"}, "child", None), ({"isFork": "yes", "description": "d"}, "child", None), ([1], "child", None), (None, "child", None), ({"agentType": None, "description": "d"}, "child", "d"),
]


def test_metadata(spark):
    paths = [f"/h/p/s{k}/subagents/agent-{k}.jsonl" for k in range(len(METAS))]
    files = spark.createDataFrame([(p,) for p in paths] + [("/h/p/s.jsonl",), ("/h/p/agent-1.jsonl",), ("s/subagents/agent-.jsonl",), ("/h/p/broken/subagents/agent-b.jsonl",)], "path string")
    metas = spark.createDataFrame([(p.replace(".jsonl", ".meta.json"), json.dumps(m)) for p, (m, *_) in zip(paths, METAS) if m is not None] + [("/h/p/broken/subagents/agent-b.meta.json", "{")], "path string, value string")
    got = {r.path: (r.parent, r.agent_id, r.kind, r.summary) for r in sidecars.described(files, metas).collect()}
    assert got == {p: (f"/h/p/s{k}.jsonl", str(k), kind, summary) for k, (p, (_, kind, summary)) in enumerate(zip(paths, METAS))} | {"s/subagents/agent-.jsonl": ("s.jsonl", "", "child", None), "/h/p/broken/subagents/agent-b.jsonl": ("/h/p/broken.jsonl", "b", "child", None)}


def test_text_of_agents_is_cut_and_ordered(spark):
    agents = spark.createDataFrame([("p/subagents/agent-a.jsonl", "p.jsonl", "child"), ("p/subagents/agent-b.jsonl", "p.jsonl", "branch")], "path string, parent string, kind string")
    part = lambda t: [("dialogue", t)]
    said = spark.createDataFrame([("p/subagents/agent-a.jsonl", 2, part("two")), ("p/subagents/agent-a.jsonl", 1, part("one\x1b[0m")), ("p/subagents/agent-a.jsonl", 3, part("  ")), ("p/subagents/agent-a.jsonl", 4, part("y" * 40_000)), ("p/subagents/agent-b.jsonl", 1, part("no"))], "path string, ordinal int, parts array<struct<source:string,text:string>>")
    got = {r.path: r.agent_text for r in sidecars.with_agents(spark.createDataFrame([("p.jsonl",), ("q.jsonl",)], "path string"), agents, said).collect()}
    assert got == {"p.jsonl": "one two " + "y" * 16_384, "q.jsonl": None}
    short = sidecars.with_agents(spark.createDataFrame([("p.jsonl",)], "path string"), agents, said, most=100).first().agent_text
    assert len(short) == 101 and short.startswith("one two y")


FRAMES = [
    ("<task-notification> <task-id>1</task-id></task-notification>\n", True, None), ("<task-notification><task-id>1</task-id>", False, None), ("<task-notification>x<task-id>1</task-id></task-notification>", False, None),
    ("<task-notification><task-id>1</task-id></task-notification></task-notification>", False, None), ("<task-notification>", False, None), ("</task-notification>", False, None),
    ("<fork-boilerplate>a</fork-boilerplate> Your directive:  do it ", False, "do it"), ("<fork-boilerplate>a</fork-boilerplate>ask", False, "ask"), ("<fork-boilerplate>open", False, None),
    (f" {sidecars.MID_OPEN} a{sidecars.MID_CLOSE} b{sidecars.MID_CLOSE} c", False, f"a{sidecars.MID_CLOSE} b"), (f"{sidecars.MID_OPEN} plain", False, "plain"), ("other", False, None), ("", False, None),
]


def test_frames(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(FRAMES)], "k int, t string")
    got = {r.k: (r.n, r.u) for r in rows.select("k", sidecars.is_task_notification(F.col("t")).alias("n"), sidecars.unframed(F.col("t")).alias("u")).collect()}
    assert got == {k: want for k, (_, *want) in enumerate(FRAMES) for want in [tuple(want)]}
    asked = spark.createDataFrame([("/btw  why ",), ("/btwx",), ("/clear",)], "t string").select(sidecars.side_question(F.col("t")).alias("q")).collect()
    assert [r.q for r in asked] == ["why", None, None]


def test_own_files(spark):
    rows = [("a", "tree", [], "tree"), ("b", "tree", [], "rollout"), ("c", "tree", ["rollout"], "rollout"), ("d", "flat", [], "tree")]
    got = sidecars.own_files(spark.createDataFrame(rows, "path string, source string, also array<string>, written_by string"))
    assert sorted(r.path for r in got.collect()) == ["a", "c", "d"]


U = "0aB1c2d3-4444-5555-6666-777788889999"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ch_0aB1c2d3", ("digest", "0ab1c2d3", None)), ("ch_0ab1c2d", (None, None, retrieval.TOO_SHORT)), ("ch_" + "0" * 33, (None, None, retrieval.TOO_LONG)), ("ch_0ab1c2dg", (None, None, retrieval.NOT_HEX)), ("ch_", (None, None, retrieval.TOO_SHORT)),
        (U, ("uuid", U.lower(), None)), (U + ".jsonl", ("file", U, None)), ("a_b_" + U, ("file", "a_b_" + U, None)), ("_" + U, (None, None, retrieval.OTHER_FORM)), ("x/" + U, (None, None, retrieval.OTHER_FORM)), (U + "\n", (None, None, retrieval.OTHER_FORM)), ("", (None, None, retrieval.OTHER_FORM)),
    ],
)
def test_forms_of_references(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(retrieval.reference_form(F.col("t")).alias("f")).first().f) == want


def test_old_refs_only_where_no_new_one_is(spark):
    keys = spark.createDataFrame([(1, "a" * 32, "b" * 32, U, "f.jsonl"), (2, "b" * 32, "c" * 32, U, "g.jsonl")], "key int, ref string, legacy_ref string, uuid string, file string")
    asked = spark.createDataFrame([("ch_" + x * 8,) for x in "abcd"] + [(U,)], "input string")
    got = {r.input[-1] if r.input != U else "u": (r.state, r.key, r.candidates) for r in retrieval.resolved_refs(asked, keys).collect()}
    assert got == {"a": ("found", 1, None), "b": ("found", 2, None), "c": ("found", 2, None), "d": ("not found", None, None), "u": ("ambiguous", None, ["a" * 32, "b" * 32])}


# -- embedding as a stream --------------------------------------------------------------------------------------------
def test_a_stopped_stream_goes_on_to_the_same_table(spark, tmp_path):
    texts = [f"text {k % 25} of file" for k in range(40)]
    (tmp_path / "in").mkdir()
    for k in range(8):
        (tmp_path / "in" / f"f{k}.jsonl").write_text("\n".join(texts[k * 5 : k * 5 + 5]) + "\n")
    stream = lambda: embedding.session_stream(spark, str(tmp_path / "in"), page=1).select(F.col("value").alias("text"))
    folder, check, calls = f"file://{tmp_path}/store", str(tmp_path / "check"), []

    def after_two():
        calls.append(1)
        return (tmp_path / "store" / "batch=1").exists()

    assert embedding.embed_stream(stream(), folder, check, stop=after_two, poll_seconds=0.02) is False and calls
    half = embedding.stored(spark, folder).count()
    assert 0 < half < 25
    assert embedding.embed_stream(stream(), folder, check) is True
    got = {r.text_hash: [round(x, 6) for x in r.embedding] for r in embedding.stored(spark, folder).collect()}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text_hash", semantic.content_key(F.col("text")))
    want = {r.text_hash: [round(x, 6) for x in r.embedding] for r in semantic.embed_missing(rows, spark.createDataFrame([], "text_hash string, embedding array<float>")).collect()}
    assert got == want and embedding.stored(spark, folder).count() == 25


def test_a_batch_twice_and_a_budget(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    run = embedding.embed_batch(folder, most=3)
    batch = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    run(batch, 0)
    run(batch, 0)
    assert embedding.stored(spark, folder).count() == 2
    run(spark.createDataFrame([("b",), ("c",), ("d",)], "text string"), 1)
    assert embedding.stored(spark, folder).count() == 3
    run(spark.createDataFrame([("e",)], "text string"), 2)
    assert embedding.stored(spark, folder).count() == 3


def test_quiet_bursts_on_a_stream(spark, tmp_path):
    from palaver.streaming.quiet import quiet_sessions

    rows = spark.createDataFrame([(1, s) for s in (0, 10, 20, 500, 505)] + [(2, 7), (1, 5000)], "user_id int, at int").select("user_id", F.timestamp_seconds("at").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = quiet_sessions(stream, "60 seconds", "10 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, int(r.first_ts.timestamp()), int(r.last_ts.timestamp()), r.n) for r in spark.table("bursts").collect()}
    assert got == {(1, 0, 20, 3), (1, 500, 505, 2), (2, 7, 7, 1)}
