"""Events to messages to conversations: ordinals, previews, counters, tokens, durations, keywords.

Folds are windows and aggregates by conversation. Messages have key, turn, role, text and, where a source gives them,
message_id, usage and ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import one_spaced

PREVIEW_PARTS, ROUTE_WORDS = 3, 100


def counts_as_message(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def ordinals(messages: DataFrame) -> DataFrame:
    """Adds ``ordinal`` from 1: system rows and blank rows take none, an assistant needs a user before it, and a repeated
    assistant message_id keeps its first ordinal (the later row replaces it)."""
    by = Window.partitionBy("key").orderBy("turn")
    rows = messages if "message_id" in messages.columns else messages.withColumn("message_id", F.lit(None).cast("string"))
    rows = rows.where((F.col("role") != "system") & counts_as_message(F.col("text")))
    rows = rows.withColumn("met", F.max((F.col("role") == "user").cast("int")).over(by)).where((F.col("role") == "user") | (F.col("met") == 1))
    same = Window.partitionBy("key", "role", "message_id").orderBy("turn")
    named = (F.col("role") == "assistant") & F.col("message_id").isNotNull()
    rows = rows.withColumn("new", F.when(named, F.row_number().over(same) == 1).otherwise(F.lit(True)))
    rows = rows.withColumn("at", F.sum(F.col("new").cast("int")).over(by))
    rows = rows.withColumn("ordinal", F.when(named, F.first("at").over(same)).otherwise(F.col("at")))
    return rows.drop("met", "new", "at")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per key of messages with ordinals: counts, text, first and last previews (the last in reverse order)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda m: one_spaced(m["text"]))
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("ordinal", "text")))), lambda m: one_spaced(m["text"]))
    rows = messages.groupBy("key").agg(F.max("ordinal").alias("message_count"), F.count_if(F.col("role") == "user").alias("prompt_count"), parts.alias("parts"), own.alias("own"))
    return rows.select(
        "key", "message_count", "prompt_count",
        F.array_join(F.slice("parts", 1, PREVIEW_PARTS), " ... ").alias("preview_first"),
        F.array_join(F.slice(F.reverse("parts"), 1, PREVIEW_PARTS), " ... ").alias("preview_last"),
        F.array_join("parts", " ").alias("full_text"), F.array_join("own", " ").alias("own_text"),
    )


def duration_minutes(first: Column, last: Column) -> Column:
    """Whole minutes, null if none passed."""
    minutes = F.floor((F.unix_timestamp(last) - F.unix_timestamp(first)) / 60)
    return F.when(minutes > 0, minutes)


def total_tokens(usages: DataFrame) -> DataFrame:
    """Of (key, message_id, line, tokens): the last usage of each id, and every usage without an id."""
    last = usages.where("message_id is not null").groupBy("key", "message_id").agg(F.max_by("tokens", "line").alias("tokens"))
    return last.select("key", "tokens").unionByName(usages.where("message_id is null").select("key", "tokens")).groupBy("key").agg(F.sum("tokens").alias("total_tokens"))


def counter_deltas(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``delta`` of a running total; a smaller total starts the counter anew."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before))


def keywords(texts: DataFrame, stop: list[str] = (), most: int = ROUTE_WORDS) -> DataFrame:
    """(key, word, n, rank): words of 4 to 40 characters, by count, then length, then first position."""
    words = texts.select("key", F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("at", "word")).where(F.length("word").between(4, 40))
    if stop:
        words = words.where(~F.col("word").isin(*stop))
    counts = words.groupBy("key", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), F.desc(F.length("word")), F.asc("first"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("key", "word", "n", "rank")


def tool_runs(events: DataFrame) -> DataFrame:
    """Adjacent events of one type merged (gaps and islands): user_id, run, event_type, n, first and last time."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("start", (F.lag("event_type").over(by).isNull() | (F.lag("event_type").over(by) != F.col("event_type"))).cast("int"))
    rows = rows.withColumn("run", F.sum("start").over(by))
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def finished(conversations: DataFrame, flags: DataFrame) -> DataFrame:
    """Conversations with what their flags (key, child, automated, clear_only) decide: a child has no own text (its prompts are
    another's), children and automated ones are not ``embedded``, and ``skipped`` says why one is not kept at all."""
    rows = conversations.join(flags, "key", "left")
    is_ = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("child", "automated", "clear_only")}
    own = F.when(is_["child"], "").otherwise(F.col("own_text"))
    skipped = F.when(is_["clear_only"], "clear only").when(F.coalesce(F.col("message_count"), F.lit(0)) == 0, "empty")
    return rows.withColumns({"own_text": own, "embedded": ~(is_["child"] | is_["automated"]), "skipped": skipped})


def project_folder(path: Column) -> Column:
    """A path as the name of its log folder."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")
