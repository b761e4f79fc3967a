import json

import pytest
import zstandard
from pyspark.sql import functions as F

from palaver.sources import sessions

ID = "0190a0b0-1111-4222-8333-0123456789ab"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")

    def put(name, rows):
        (d / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")

    put("flat.jsonl", [
        {"type": "custom-title", "customTitle": "A title"},
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello there"}},
        "{torn",
        {"type": "assistant", "timestamp": "2024-01-01T00:01:00Z", "message": {"id": "m1", "model": "x", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"path": "a"}}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}, "origin": {"kind": "human"}},
        {"type": "something-new"},
    ])
    put("tree.jsonl", [
        {"type": "title", "title": "Slot title"},
        {"type": "session", "version": 3, "id": "s", "cwd": "/x"},
        {"type": "message", "id": "a", "parentId": None, "message": {"role": "user", "content": "root"}},
        {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "content": [{"type": "text", "text": "LEFT BEHIND"}]}},
        {"type": "message", "id": "c", "parentId": "a", "message": {"role": "bashExecution", "command": "ls", "output": "f", "exitCode": 1}},
        {"type": "custom_message", "id": "h", "parentId": "c", "content": "HIDDEN", "display": False},
        {"type": "message", "id": "d", "parentId": "h", "message": {"role": "toolResult", "toolCallId": "k", "isError": True, "content": [{"type": "text", "text": "bad"}]}},
    ])
    put(f"rollout-2024-01-01T00-00-00-{ID}.jsonl", [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": ID}},
        {"timestamp": "2024-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": "m"}},
        {"timestamp": "2024-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "q"}},
        {"timestamp": "2024-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "function_call", "namespace": "ns", "name": "run", "call_id": "c", "arguments": "{}"}},
        *[{"timestamp": "2024-01-01T00:00:03Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}} for i, c, o in ((10, 4, 1), (25, 9, 3), (5, 0, 1))],
    ])
    return d


@pytest.fixture(scope="module")
def events(spark, root):
    return [r.asDict(True) for r in sessions.events(sessions.lines(spark, str(root))).orderBy("path", "line").collect()]


def test_flat(events):
    rows = [r for r in events if r["path"].endswith("flat.jsonl")]
    assert [(r["kind"], r["role"], r["text"]) for r in rows] == [("title", None, "A title"), ("message", "user", "hello there"), ("message", "assistant", "hi"), ("message", "user", ""), ("other", None, None)]
    assert rows[2]["tools"] == [{"id": "t1", "name": "Read", "input": '{"path":"a"}'}] and rows[2]["usage"]["output"] == 4
    assert rows[3]["results"] == [{"id": "t1", "output": "done"}]


def test_tree_keeps_the_active_branch(events):
    rows = [r for r in events if r["path"].endswith("tree.jsonl")]
    assert [(r["kind"], r["text"]) for r in rows] == [("title", "Slot title"), ("message", "root"), ("message", "$ ls\nf\n[exit code 1]"), ("other", None), ("message", "Error: bad")]


def test_rollout_token_deltas(events):
    rows = [r for r in events if "rollout" in r["path"]]
    assert [(r["usage"]["input"], r["usage"]["cache_read"], r["usage"]["output"]) for r in rows if r["usage"]] == [(6, 4, 1), (10, 5, 2), (5, 0, 1)]
    assert [r["tools"][0]["name"] for r in rows if r["tools"]] == ["ns__run"] and all(r["model"] == "m" for r in rows[1:])


def test_malformed_lines_are_rows(spark, root):
    bad = sessions.malformed(sessions.lines(spark, str(root))).collect()
    assert [(r.line, len(r.before), len(r.after)) for r in bad] == [(3, 2, 2)]


def test_compressed_and_names(spark, root, tmp_path):
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress((root / "flat.jsonl").read_bytes()))
    plain = sessions.lines(spark, str(root), "flat.jsonl").select("line", "value").collect()
    assert sorted(sessions.compressed_lines(spark, str(tmp_path)).select("line", "value").collect()) == sorted(plain)
    got = sessions.lines(spark, str(root)).select(sessions.thread_of(F.col("path")).alias("t")).distinct().collect()
    assert {r.t for r in got} == {"", ID}
    names = sessions.last_names(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "")], "thread_id string, line int, name string")).collect()
    assert [tuple(r) for r in names] == [("a", "y")]
    user = spark.createDataFrame([('{"isCompactSummary":true}',), ('{"origin":{"kind":"human"}}',), ("{}",)], "raw string").select(sessions.generated_user(F.col("raw")).alias("g")).collect()
    assert [r.g for r in user] == [True, False, None]
