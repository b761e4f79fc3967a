"""Keyword ranking of conversations: gate, field weights, adjacency, recency, literals.

The scan path over stored normalised columns. A query compiles to column expressions only: cheap ``contains`` tests
first, word-start patterns next, scores of the survivors last; ``orderBy().limit()`` becomes a distributed top-k.
Input columns: key, ts, title, summary, project, body and the ``*_norm`` columns of ``prepare``.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.query import Literal, Query, parse
from palaver.functions.spans import literal_pattern
from palaver.functions.text import at_word_start, count_at_word_start, has_cjk, normalized

# Fixed values of the ranking.
WEIGHTS = {"title": 5.0, "summary": 3.0, "project": 4.0, "body": 1.0}
TF_CAP, PAIR_CAP, PAIR_FACTOR, PAIR_BYTES = 10, 3, 2.0, 3
FRESH_MOST, HALF_LIFE_DAYS, CJK_FLAT = 2.0, 7.0, 0.5


def prepare(conversations: DataFrame) -> DataFrame:
    """Adds the normalised columns that searches read; store the result."""
    return conversations.withColumns({f"{c}_norm": normalized(F.coalesce(c, F.lit(""))) for c in WEIGHTS})


def freshness(ts: Column, now: datetime, ahead: bool = False) -> Column:
    """Recency by its half-life. A time after ``now`` counts as now; with ``ahead`` it goes on growing."""
    age = F.lit(int(now.timestamp())) - F.unix_timestamp(ts)
    fresh = F.lit(FRESH_MOST) * F.pow(F.lit(2.0), -(age / F.lit(86400.0)) / F.lit(HALF_LIFE_DAYS))
    return fresh if ahead else F.when(age < 0, F.lit(FRESH_MOST)).otherwise(fresh)


def pairs(words: tuple[str, ...]) -> list[str]:
    """Each word, a space, and the first bytes of the next (one character at least)."""
    out = []
    for a, b in zip(words, words[1:], strict=False):
        head = b.encode()[:PAIR_BYTES].decode(errors="ignore") or b[0]
        out.append(f"{a} {head}")
    return out


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def literal_matches(text: Column, literal: Literal) -> Column:
    """The literal at a word start, its end free; without capitals each character matches by its lower case. What holds it at all
    is found first, which costs less than the pattern (of ASCII: lower case of other texts may depend on what stands beside)."""
    found = text.rlike(literal_pattern(literal))
    if literal.sensitive:
        return text.contains(literal.text) & found
    return F.lower(text).contains(literal.text) & found if literal.text.isascii() else found


def literal_text() -> Column:
    return F.concat_ws(" ", "body", "project")


def gate(words: tuple[str, ...]) -> tuple[Column, Column]:
    """(every word somewhere in body or project, every word at a word start there)"""
    body, project = F.col("body_norm"), F.col("project_norm")
    cheap = _all([body.contains(w) | project.contains(w) for w in words])
    exact = _all([body.rlike(at_word_start(w)) | project.rlike(at_word_start(w)) for w in words])
    return cheap, exact


def field_scores(words: tuple[str, ...]) -> dict[str, Column]:
    out = {}
    for name, weight in WEIGHTS.items():
        text = F.col(f"{name}_norm")
        tf = sum((F.log(1.0 + count_at_word_start(text, w, TF_CAP)) for w in words), F.lit(0.0))
        near = sum((F.regexp_count(text, F.lit(at_word_start(p))) for p in pairs(words)), F.lit(0))
        out[f"{name}_tf"] = F.lit(weight) * tf
        out[f"{name}_near"] = F.lit(weight * PAIR_FACTOR) * F.least(near, F.lit(PAIR_CAP))
    return out


def search(prepared: DataFrame, query: str | Query, now: datetime, top: int | None = None, explain: bool = False, ahead: bool = False) -> DataFrame:
    """Ranked rows with ``score``: score, then time, then key. ``explain`` adds each field's parts; ``ahead`` as in ``freshness``."""
    q = parse(query) if isinstance(query, str) else query
    fresh = freshness(F.col("ts"), now, ahead)
    if q.is_empty:
        found = prepared.withColumn("score", fresh)
        return _top(found, [F.desc("ts"), F.asc("key")], top)
    found = prepared.where(_all([literal_matches(literal_text(), x) for x in q.literals])) if q.literals else prepared
    if not q.words:
        return _top(found.withColumn("score", fresh), [F.desc("ts"), F.asc("key")], top)
    cheap, exact = gate(q.words)
    found = found.where(cheap)
    parts = field_scores(q.words)
    total = sum(parts.values(), F.lit(0.0)) + fresh
    if any(map(has_cjk, q.words)):
        found = found.withColumn("score", F.when(exact, total).otherwise(F.lit(CJK_FLAT * len(q.words)) + fresh))
    else:
        found = found.where(exact).withColumn("score", total)
    if explain:
        found = found.withColumns(parts).withColumn("fresh", fresh)
    return _top(found, [F.desc("score"), F.desc("ts"), F.asc("key")], top)


def _top(found: DataFrame, order: list[Column], top: int | None) -> DataFrame:
    return found.orderBy(*order).limit(top) if top else found.orderBy(*order)


def list_rows(conversations: DataFrame, after: datetime | None = None, before: datetime | None = None, exclude: list[str] = (), prefixes: list[str] = (), all_kinds: bool = False) -> DataFrame:
    """Scope of a listing: time, hidden kinds (automated or child), projects by name or the part before a slash, paths by
    prefix. Plain predicates, so they reach the scan."""
    out = conversations
    if after:
        out = out.where(F.col("ts") >= F.lit(after))
    if before:
        out = out.where(F.col("ts") < F.lit(before))
    if exclude:
        out = out.where(~(F.col("project").isin(*exclude) | F.substring_index("project", "/", 1).isin(*exclude)))
    for p in filter(None, prefixes):
        out = out.where(~F.coalesce(F.col("cwd").startswith(p), F.lit(False)))
    if not all_kinds:
        out = out.where(~(F.col("automated") | F.col("child")))
    return out

