"""Layouts of tools, passages of agents, local times."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palaver.functions.query import time_range
from palaver.functions.text import normalize, starts_word
from palaver.operators import semantic, tools

CALLS = [
    ("Bash", {"command": "ls\n"}, ("Bash: ls\n", None)),
    ("bash", {"command": "a\nb\r\nc"}, ("Bash: a", "b\nc")),
    ("Bash", {}, ("Bash: ", None)),
    ("Read", {"file_path": "/f", "path": "/g", "offset": 3, "limit": 4}, ("Read: /f:3-7", None)),
    ("read", {"path": "/g", "offset": 3}, ("Read: /g:3", None)),
    ("Read", {"file_path": 5, "limit": 4}, ("Read: ", None)),
    ("Read", {"file_path": "/f", "offset": -3}, ("Read: /f", None)),
    ("Grep", {"pattern": "x"}, ('Grep: "x" in .', None)),
    ("Grep", {"pattern": "x", "glob": "*.c"}, ('Grep: "x" in *.c', None)),
    ("Glob", {"pattern": "x"}, ("Glob: x", None)),
    ("edit", {"path": "/p", "edits": [{"oldText": "a\nb", "newText": ""}, {"oldText": "c"}]}, ("Edit: /p", "- a\n- b")),
    ("Edit", {"file_path": "/p", "old_string": "a"}, ("Edit: /p", None)),
    ("Edit", {"file_path": "/p", "edits": [], "old_string": "a", "new_string": "b"}, ("Edit: /p", None)),
    ("fetch_content", {"urls": ["a", 1, "b"], "url": "c"}, ("Fetch: a, b", None)),
    ("WebSearch", {"query": "q"}, ('Search: "q"', None)),
    ("web_search", {}, ('Search: ""', None)),
    ("ls", {}, ("List: .", None)),
    ("suba", {"name": "", "task": ""}, ("Suba", None)),
    ("suba_list", {"status": "on", "": "x"}, ("Suba list: on", None)),
    ("process", {"id": "7", "command": "c"}, ("Process: 7", "c")),
    ("Skill", {"skill": "s"}, ("Skill: /s", None)),
    ("Skill", {"x": True}, ('Skill: { "x": true }', None)),
    ("Other", {}, ("Other: {}", None)),
    ("Other", {"z": [], "a": [{}, {"b": "q\"{,\\"}], "n": 1.5}, ('Other: { "a": [{}, { "b": "q\\"{,\\\\" }], "n": 1.5, "z": [] }', None)),
]


def test_calls(spark):
    rows = spark.createDataFrame([(k, n, json.dumps(a)) for k, (n, a, _) in enumerate(CALLS)] + [(99, "Bash", "{broken"), (100, "Other", None)], "k int, n string, a string")
    got = {r.k: tuple(r.c) for r in rows.select("k", tools.tool_call(F.col("n"), F.col("a")).alias("c")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(CALLS)} | {99: ("Bash: ", None), 100: ("Other: {}", None)}


RESULTS = [
    (None, "<no content>"), ("x \n y", "x \n y"), (" <tool_use_error> no </tool_use_error>\n", "Error: no"), ("<tool_use_error>", "<tool_use_error>"), ('{"b":1,"a":{}}', '{\n  "a": {},\n  "b": 1\n}'), ("[broken", "[broken"), ('{"a":\n1}', '{"a":\n1}'),
    ([{"type": "text", "text": "a"}, {"type": "input_image", "image_url": "data:image/gif;base64,x"}, {"type": "image"}, {"type": "tool_reference"}, {"type": "z", "text": "[1]"}], "a\n\n[image: image/gif]\n\n[image]\n\nLoaded tool: ?\n\n[\n  1\n]"),
    ([{"type": 1}], '[\n  {\n    "type": 1\n  }\n]'), ([], ""), (7, "7"), ({"k": [1, [2]]}, '{\n  "k": [\n    1,\n    [\n      2\n    ]\n  ]\n}'), ("", ""), ([{"type": "text"}], ""),
]


def test_results(spark):
    rows = spark.createDataFrame([(k, None if c is None else json.dumps(c)) for k, (c, _) in enumerate(RESULTS)] + [(99, "null")], "k int, c string")
    got = {r.k: r.t for r in rows.select("k", tools.tool_result(F.col("c")).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(RESULTS)} | {99: "<no content>"}


# -- passages of agents -----------------------------------------------------------------------------------------------
def plain_cut(text, most):
    out = []
    while text:
        n = max([k for k in range(1, len(text) + 1) if len(text[:k].encode()) <= most] or [1])
        out.append(text[:n])
        text = text[n:]
    return out


@pytest.mark.parametrize("query", [None, "readFile error", "the", "alpha beta gamma delta", "x"])
def test_passages_equal_a_plain_version(spark, query):
    random.seed(3)
    words = "readFile read file error alpha beta gamma é日本 deltaForce".split()
    rows = [(k % 5, k, p, random.choice(["dialogue", "tool", "thinking"]), random.random() < 0.4, " ".join(random.choice(words) for _ in range(random.randrange(0, 60)))) for k in range(40) for p in range(2)]
    terms, want = semantic.tool_terms(query) if query else [], []
    for key, ordinal, part, source, sub, text in rows:
        name = ("subagent-" if sub else "") + source
        cuts = plain_cut(text, 50) if source == "tool" else [text]
        if source == "tool" and query is not None:
            scored = []
            for n, cut in enumerate(cuts):
                spaced = "".join(" " + c if n_ and c.isupper() and cut[n_ - 1].islower() else c for n_, c in enumerate(cut))
                norm = normalize(spaced)
                met = sum(any(norm.startswith(t, at) and starts_word(norm, at) for at in range(len(norm))) for t in terms)
                if met >= (2 if len(terms) >= 3 else 1):
                    scored.append((met, n, cut))
            cuts = {max(scored)[1]: max(scored)[2]} if scored else {}
        else:
            cuts = dict(enumerate(cuts))
        want += [(key, ordinal, part, name, n, c.strip()) for n, c in cuts.items() if c.strip()]
    table = spark.createDataFrame(rows, "key int, ordinal int, part int, source string, subagent boolean, text string")
    got = semantic.agent_passages(table, query, 50).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_characters_larger_than_a_part(spark):
    got = spark.createDataFrame([("日x𝒳",), ("",), (None,)], "t string").select(semantic.byte_segments(F.col("t"), F.lit(2)).alias("s")).collect()
    assert [r.s for r in got] == [["日", "x", "𝒳"], [], None]


def test_terms_of_a_query():
    assert semantic.tool_terms("How does the readFile() (parse) parse x?") == ["read", "file", "parse"]


# -- local times ------------------------------------------------------------------------------------------------------
NOW = datetime(2024, 12, 1, tzinfo=timezone.utc)


def utc(*at):
    return datetime(*at, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("after", "before", "zone", "want"),
    [
        ("2024-03-31", "2024-03-31", "Europe/Berlin", (utc(2024, 3, 30, 23), utc(2024, 3, 31, 22))),  # 23 hours
        ("2024-10-27", "2024-10-27", "Europe/Berlin", (utc(2024, 10, 26, 22), utc(2024, 10, 27, 23))),  # 25 hours
        ("2024-10-27T02:30", "2024-10-27T02:30", "Europe/Berlin", (utc(2024, 10, 27, 0, 30), utc(2024, 10, 27, 1, 31))),  # comes twice
        ("2024-11-03T01", "2024-11-03T01", "America/New_York", (utc(2024, 11, 3, 5), utc(2024, 11, 3, 7))),
        ("2024-03-10", "2024-03-10", "America/New_York", (utc(2024, 3, 10, 5), utc(2024, 3, 11, 4))),
        ("2024-03-31", "2024-03-31", "UTC", (utc(2024, 3, 31), utc(2024, 4, 1))),
        ("3d", None, "Europe/Berlin", (utc(2024, 11, 28), None)),
    ],
)
def test_days_on_which_clocks_change(after, before, zone, want):
    assert time_range(after, before, NOW, zone) == want


@pytest.mark.parametrize(("after", "before", "zone"), [("2024-03-31T02:30", None, "Europe/Berlin"), (None, "2024-03-10T02:10", "America/New_York"), ("2024-03-10T02", None, "America/New_York"), ("2024-05-02", "2024-05-01", "Europe/Berlin")])
def test_times_that_are_none(after, before, zone):
    with pytest.raises(ValueError):
        time_range(after, before, NOW, zone)
