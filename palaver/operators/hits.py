"""Search over messages: hits of ranked conversations, hits of ranked passages, their fusion and final order.

Rankings of conversations are shortlists (500 rows at the most, ``retrieval.shortlist``), so they are broadcast; messages and
passages are read once, cut to the shortlist by that join, and only their hits move between tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import at_word_start, one_spaced, without_escapes
from palaver.operators import retrieval

# Fixed values of previews.
BEFORE, AFTER, PREVIEW = 40, 80, 160
SEGMENT_CHARS = 16 * 1024


def segments(messages: DataFrame) -> DataFrame:
    """One row for each part of (key, ordinal, role, text, thinking, tools, results): source and text. Blank parts give none;
    a tool call reads as its summary."""
    parts = F.concat(
        F.array(F.struct(F.lit("dialogue").alias("source"), F.col("text").alias("text")), F.struct(F.lit("thinking").alias("source"), F.col("thinking").alias("text"))),
        F.transform("tools", lambda t: F.struct(F.lit("tool").alias("source"), F.concat(F.lit("tool "), t["name"], F.lit(" input_keys="), F.coalesce(F.array_join(F.json_object_keys(t["input"]), ","), F.lit(""))).alias("text"))),
        F.transform("results", lambda r: F.struct(F.lit("tool").alias("source"), r["output"].alias("text"))),
    )
    rows = messages.select("key", "ordinal", "role", F.posexplode(parts).alias("part", "at"))
    text = F.left(without_escapes(F.col("at.text")), F.lit(SEGMENT_CHARS))
    return rows.select("key", "ordinal", "role", "part", F.col("at.source").alias("source"), text.alias("text")).where(F.coalesce(F.trim("text"), F.lit("")) != "")


def source_rank(source: Column) -> Column:
    return F.when(source == "dialogue", 0).when(source == "tool", 1).otherwise(2)


def preview(text: Column, words: list[str]) -> Column:
    """The text around the first word found: 40 characters before it, 80 behind it, on one line, 160 at most."""
    found = [F.regexp_instr(text, F.lit("(?iu)" + at_word_start(w))) for w in words]
    starts = [F.struct(F.when(at > 0, at).alias("at"), F.lit(len(w)).alias("n")) for at, w in zip(found, words, strict=True)]
    first = F.array_min(F.filter(F.array(*starts), lambda s: s["at"].isNotNull()))
    at, n = F.coalesce(first["at"], F.lit(1)), F.coalesce(first["n"], F.lit(0))
    low = F.greatest(at - BEFORE, F.lit(1))
    return F.left(one_spaced(without_escapes(F.substring(text, low, at + n + AFTER - low))), F.lit(PREVIEW))


def shortlisted(ranked: DataFrame, order: list[Column], top: int) -> DataFrame:
    """(key, rank) of the first conversations of a ranking, as many as a shortlist for ``top`` holds."""
    first = ranked.orderBy(*order).limit(retrieval.shortlist(top))
    return first.select("*", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def global_hits(ranked: DataFrame, cards: DataFrame, messages: DataFrame, words: list[str], each: int) -> DataFrame:
    """(key, rank, ordinal, score, preview): every conversation of ``ranked`` (key, rank) has hits. Messages (key, ordinal, text,
    text_norm) with every word, else with some, ``each`` of a conversation at most; else its first message at score 0 with
    the title, summary or project (of ``cards``) that matched."""
    near = messages.join(F.broadcast(ranked.select("key", "rank")), "key")
    by = Window.partitionBy("key").orderBy(F.desc("score"), "ordinal")
    found = retrieval.message_hits(near, words, partial=True).withColumn("place", F.row_number().over(by)).where(F.col("place") <= each)
    found = found.select("key", "rank", F.col("ordinal").cast("long").alias("ordinal"), "score", preview(F.col("text"), words).alias("preview"))

    def names(field: str) -> Column:
        return F.when(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{field}_norm").rlike(at_word_start(w)), F.lit(False)) for w in words]), F.col(field))

    shown = F.coalesce(names("title"), names("summary"), names("project"), F.col("title"))
    first = near.groupBy("key", "rank").agg(F.min("ordinal").cast("long").alias("ordinal")).join(found.select("key").distinct(), "key", "left_anti")
    whole = first.join(cards.select("key", shown.alias("shown")), "key")
    return found.unionByName(whole.select("key", "rank", "ordinal", F.lit(0.0).alias("score"), F.left(one_spaced("shown"), F.lit(PREVIEW)).alias("preview")))


def first_appearance(passages: DataFrame) -> DataFrame:
    """(key, rank) of conversations by their first place in ranked passages (key, place). Route passages count: they rank a
    conversation although they are never shown."""
    first = passages.groupBy("key").agg(F.min("place").alias("first"))
    return first.select("key", F.row_number().over(Window.orderBy("first")).cast("long").alias("rank"))


def shown_passages(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("source") != "route")


def fused(lexical: DataFrame, semantic: DataFrame, semantic_ranks: DataFrame) -> DataFrame:
    """Hits of both searches. ``lexical`` has key, rank, ordinal, score; ``semantic`` key, ordinal, score; ``semantic_ranks``
    key, rank. Hits on one message become one of kind hybrid; a hit's score fuses the ranks of its conversation in both
    searches, its evidence is the message's own score (the keyword score where there is one)."""
    a = lexical.select("key", "ordinal", F.col("score").alias("l_score"))
    b = semantic.groupBy("key", "ordinal").agg(F.max("score").alias("s_score"))
    lex_ranks = lexical.select("key", F.col("rank").alias("lex_rank")).distinct()
    both = a.join(b, ["key", "ordinal"], "full_outer").join(F.broadcast(lex_ranks), "key", "left").join(F.broadcast(semantic_ranks.select("key", F.col("rank").alias("sem_rank"))), "key", "left")
    share = sum(F.coalesce(1.0 / (retrieval.RRF_K + F.col(c)), F.lit(0.0)) for c in ("lex_rank", "sem_rank"))
    kind = F.when(F.col("l_score").isNull(), "semantic").when(F.col("s_score").isNull(), "lexical").otherwise("hybrid")
    return both.select("key", "ordinal", kind.alias("kind"), share.alias("score"), F.coalesce("l_score", "s_score").alias("evidence"))


def fused_order() -> list[Column]:
    return [F.desc(F.round("score", 12)), F.when(F.col("kind") == "semantic", 2).otherwise(1), F.desc("evidence"), F.asc("key"), F.asc("ordinal")]


def finalized(hits: DataFrame, top: int, each: int | None = None, flat: bool = False) -> DataFrame:
    """Hits (key, rank, ordinal, source, score) in their conversations' order. Grouped: the first ``top`` conversations, ``each``
    hits of one; flat: the first ``top`` hits, one for a message. Within a conversation: tenths of the score, dialogue
    before tools before thinking, score, place."""
    own = [F.floor(F.col("score") * 10).desc(), source_rank(F.col("source")), F.desc("score"), F.asc("ordinal")]
    if flat:
        one = Window.partitionBy("key", "ordinal").orderBy(*own)
        rows = hits.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
        return rows.orderBy("rank", *own).limit(top)
    first = hits.select("key", "rank").distinct().orderBy("rank").limit(top)
    rows = hits.join(F.broadcast(first.select("key")), "key", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*own)).cast("long"))
    return rows.where(F.col("place") <= each) if each else rows


def within_scope(conversations: DataFrame, keys: DataFrame) -> DataFrame:
    """Conversations that ``keys`` names, before anything is ranked."""
    return conversations.join(keys.select("key").distinct(), "key", "left_semi")
