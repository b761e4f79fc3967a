"""Messages that match a search string, scored by what matched where.

A message is its segments (``hits.segments``) joined by line ends. A word hit spans its whole segment, a quoted text its own
bytes; a message's score takes the distinct terms, the quoted texts, the pairs in order and the span of all hits. All of
it is expressions on segments and one aggregate by message; only messages that the string can match are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.query import Query, parse
from palaver.functions.spans import literal_pattern, literal_span
from palaver.functions.text import at_word_start, has_cjk, one_spaced, without_escapes
from palaver.operators.hits import PREVIEW, source_rank

# Fixed values of the score and the preview.
PER_TERM, PER_LITERAL, PER_PAIR = 4.0, 3.0, 2.0
BEFORE, AFTER = 41, 80
SOURCES = ("dialogue", "tool", "thinking")


def _total(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions], F.lit(0))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _joined(field: str, between: str) -> Column:
    """A field of a message's segments in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", field))), lambda s: s[field]), between)


def match_messages(segments: DataFrame, query: str | Query, partial: bool = False) -> DataFrame:
    """(key, ordinal, score, source, first, last, preview, tools, thinking, terms) of segments (key, ordinal, part, source, text,
    norm). Every word (at a word start, or anywhere with CJK words) and every quoted text must be there; with ``partial`` a
    conversation without such a message gives those with some of them. ``first`` and ``last`` are bytes of the message."""
    q = parse(query) if isinstance(query, str) else query
    words, literals = list(q.words), list(q.literals)
    if not words and not literals:
        return segments.limit(0).select("key", "ordinal", *[F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("source", "string"), ("first", "bigint"), ("last", "bigint"), ("preview", "string"), ("tools", "boolean"), ("thinking", "boolean"), ("terms", "int"))])
    anywhere = any(map(has_cjk, words))
    size = F.octet_length("text")
    before = Window.partitionBy("key", "ordinal").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("offset", F.coalesce(F.sum(size + 1).over(before), F.lit(0)))
    found = {f"w{k}": F.col("norm").contains(w) if anywhere else F.col("norm").rlike(at_word_start(w)) for k, w in enumerate(words)}
    spans = {f"l{k}": literal_span(F.col("text"), x) for k, x in enumerate(literals)}
    found |= {k: s[0] for k, s in spans.items()}
    rows = rows.withColumns({**found, **{f"{k}_{side}": s[1 + j] for k, s in spans.items() for j, side in enumerate(("first", "last"))}})
    whole = reduce(lambda a, b: a | b, [F.col(k) for k in found if k.startswith("w")], F.lit(False))
    hit = reduce(lambda a, b: a | b, [F.col(k) for k in found], F.lit(False))
    first = F.least(*[F.when(whole, F.lit(0)), F.lit(None).cast("int"), *[F.when(F.col(k), F.col(f"{k}_first")) for k in spans]])
    last = F.greatest(*[F.when(whole, size), F.lit(None).cast("int"), *[F.when(F.col(k), F.col(f"{k}_last")) for k in spans]])
    rows = rows.withColumns({"hit": hit, "low": F.when(hit, F.col("offset") + first), "high": F.when(hit, F.col("offset") + last)})
    kept = [F.bool_or(k).alias(k) for k in found]
    joined = {"text": _joined("text", "\n"), "norm": _joined("norm", " ")}
    met = rows.groupBy("key", "ordinal").agg(
        *kept, F.min("low").alias("first"), F.max("high").alias("last"), F.min(F.when(F.col("hit"), source_rank(F.col("source")))).alias("rank"),
        F.bool_or(F.col("hit") & (F.col("source") == "tool")).alias("tools"), F.bool_or(F.col("hit") & (F.col("source") == "thinking")).alias("thinking"), *[c.alias(n) for n, c in joined.items()],
    ).where("first is not null")
    strict = _all([F.col(f"w{k}") for k in range(len(words))] + [F.col("text").rlike(literal_pattern(x)) for x in literals])
    met = met.withColumn("strict", strict)
    if partial:
        best = F.max(F.col("strict").cast("int")).over(Window.partitionBy("key"))
        met = met.withColumn("best", best).where(F.col("strict") | (F.col("best") == 0))
    else:
        met = met.where("strict")
    near = _total([F.col("norm").contains(f"{a} {b}") for a, b in zip(q.words, q.words[1:], strict=False)])
    terms = _total([F.col(k) for k in found])
    score = PER_TERM * terms + F.lit(PER_LITERAL * len(literals)) + PER_PAIR * near + 1.0 / F.greatest(F.col("last") - F.col("first"), F.lit(1))
    data = F.encode("text", "UTF-8")
    head, tail = F.substring(data, F.lit(1), F.col("first").cast("int")).cast("string"), F.substring(data, F.col("last").cast("int") + 1, F.octet_length(data)).cast("string")
    middle = F.substring(data, F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int")).cast("string")
    preview = F.left(one_spaced(without_escapes(F.concat(F.right(head, F.lit(BEFORE)), middle, F.left(tail, F.lit(AFTER))))), F.lit(PREVIEW))
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("rank") + 1)
    return met.select("key", "ordinal", score.alias("score"), source.alias("source"), "first", "last", preview.alias("preview"), "tools", "thinking", terms.alias("terms"))


def ordered(matches: DataFrame, conversations: DataFrame, each: int, quoted_only: bool = False) -> DataFrame:
    """The first ``each`` matches of a conversation with their ``place``: quoted texts alone ask for dialogue first; then score,
    newer conversations (key, ts, ref), ref, message, source and first byte."""
    rank = source_rank(F.col("source"))
    order = [*([rank.asc()] if quoted_only else []), F.desc("score"), F.asc("ordinal"), rank.asc(), F.asc("first")]
    placed = matches.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= each)
    return placed.join(conversations.select("key", "ts", "ref"), "key")


def overall(placed: DataFrame, top: int, quoted_only: bool = False) -> DataFrame:
    """The first ``top`` of all conversations' matches, in their full order."""
    rank = source_rank(F.col("source"))
    return placed.orderBy(*([rank.asc()] if quoted_only else []), F.desc("score"), F.desc("ts"), F.asc("ref"), F.asc("ordinal"), rank.asc(), F.asc("first")).limit(top)


def read_range(ordinal: Column, messages: Column, radius: int) -> Column:
    """(first, last) of what to read around a message of so many."""
    return F.struct(F.greatest(ordinal - radius, F.lit(1)).alias("first"), F.least(ordinal + radius, messages).alias("last"))
