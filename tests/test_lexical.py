import math
import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.functions.query import parse, shift_months, time_range
from palaver.functions.text import at_word_start, fold, normalize
from palaver.operators import lexical, termindex

NOW = datetime(2025, 3, 1, 12, tzinfo=timezone.utc)
# key, body, project, title, summary, age in hours
ROWS = [
    (0, "We moved the harbour crane. Harbour crane parts go by rail, parts by road", "port/crane-works", "Harbour crane", "Parts list", 5),
    (1, "a crane stood at the harbour gate", "ledger", None, None, 90),
    (2, "nothing but the crane", "harbour-office", None, None, 30),
    (3, "", "crane-notes", None, None, 700),
    (4, "uncrane and mycrane hold it inside only", "port/rail", None, None, 12),
    (5, "rail rail rail", None, None, None, 0),
]
WEIGHTS = {"title": 5, "project": 4, "body": 1}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(*r[:5], NOW - timedelta(hours=r[5])) for r in ROWS]
    return lexical.prepare(spark.createDataFrame(rows, "key int, body string, project string, title string, summary string, ts timestamp")).cache()


def plain(query):
    """The scores of ROWS for plain lower-case words, field by field, without Spark."""
    words, out = query.split(), []
    for key, body, project, title, summary, hours in ROWS:
        # the summary counts as part of the title
        text = {"title": " ".join(x for x in (title, summary) if x), "project": project or "", "body": body}
        text = {f: re.sub(r"[-/]", " ", x.lower()) for f, x in text.items()}
        starts = {f: {w: len(re.findall(rf"(?<![a-z0-9]){w}", x)) for w in words} for f, x in text.items()}
        if not all(starts["body"][w] or starts["project"][w] for w in words):
            continue
        score = sum(WEIGHTS[f] * math.log(1 + min(c, 10)) for f in text for c in starts[f].values())
        for f, x in text.items():
            near = sum(len(re.findall(rf"(?<![a-z0-9]){a} {b[:3]}", x)) for a, b in zip(words, words[1:], strict=False))
            score += 2 * WEIGHTS[f] * min(near, 3)
        out.append((key, score + 2 * 0.5 ** (hours / 24 / 7)))
    return sorted(out, key=lambda r: -r[1])


@pytest.mark.parametrize("query", ["harbour crane", "crane harbour", "rail", "crane", "ledger gate", "no-such-word"])
def test_scores(corpus, query):
    got = [(r.key, r.score) for r in lexical.search(corpus, query, NOW).collect()]
    want = plain(query)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want])


def test_browse_is_newest_first(corpus):
    assert [r.key for r in lexical.search(corpus, "  ", NOW).collect()] == [5, 0, 4, 2, 1, 3]


def test_query_parts():
    q = parse('a "b C" snake_case "  " "open')
    assert q.words == ("a",) and [(x.text, x.sensitive) for x in q.literals] == [("b C", True), ("open", False), ("snake_case", False)]
    assert parse('"x"').is_quoted_only and parse("  ").is_empty


def test_folding():
    assert fold("İstanbul ß") == "istanbul ss" and normalize("a_b-c/d　e") == "a b c d e"


def test_times():
    assert shift_months(datetime(2024, 3, 31), -1) == datetime(2024, 2, 29)
    assert time_range("2024-01", "2024-01", NOW) == (datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc))
    with pytest.raises(ValueError):
        time_range("2024-02", "2024-01-01", NOW)


def _plain_count(text, word):
    n = at = 0
    while (p := text.find(word, at)) >= 0:
        prev = text[p - 1] if p else " "
        if not prev.isalnum() or (word[0].isalnum() and prev.isnumeric() != word[0].isnumeric()):
            n, at = n + 1, p + len(word)
        else:
            at = p + 1
    return n


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab1. _é", max_size=24), min_size=20, max_size=20), st.text("ab1.", min_size=1, max_size=3))
def test_word_starts_match_a_plain_scan(spark, texts, word):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_count("t", F.lit(at_word_start(word))).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(r.t, _plain_count(r.t, word)) for r in rows]


def test_index_agrees_with_scan(spark, corpus, tmp_path):
    termindex.write_index(corpus, str(tmp_path / "index"), 4)
    index = spark.read.parquet(str(tmp_path / "index"))
    body = corpus.where(F.col("body_norm").rlike(at_word_start("crane")) & F.col("body_norm").rlike(at_word_start("harb")))
    assert {r.key for r in termindex.candidates(index, ["crane", "harb"]).collect()} == {r.key for r in body.collect()}
    merged = termindex.merged(index, termindex.terms(corpus.where("key = 1")), spark.createDataFrame([(1,)], "key int"))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in index.collect()}
