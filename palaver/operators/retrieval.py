"""Message-level retrieval: matching, scoring, fusion, grouping, reading windows, outlines, references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palaver.functions.text import at_word_start, one_spaced

RRF_K = 60
SHORT_OUTLINE, OUTLINE_STEP, SNIPPET = 20, 10, 80
MIN_REF_DIGITS, REF_DIGITS = 8, 32
_FNV_OFFSET, _FNV_PRIME = 0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B


def shortlist(top: int) -> int:
    return min(max(top * 5, 50), 500)


def message_hits(messages: DataFrame, words: list[str], partial: bool = False) -> DataFrame:
    """Messages (key, ordinal, text_norm, ...) that hold every word at a word start, with a score: 4 for each word, 2 for
    each pair in order, and a share of the inverse length. ``partial`` gives conversations without such a message those
    with some of the words."""
    text = F.col("text_norm")
    met = [text.rlike(at_word_start(w)) for w in words]
    n = sum((m.cast("int") for m in met), F.lit(0))
    near = sum((text.contains(f"{a} {b}").cast("int") for a, b in zip(words, words[1:], strict=False)), F.lit(0))
    rows = messages.withColumn("terms", n).where("terms > 0")
    rows = rows.withColumn("score", 4.0 * F.col("terms") + 2.0 * near + 1.0 / F.greatest(F.length(text), F.lit(1)))
    if not partial:
        return rows.where(F.col("terms") == len(words))
    strict = F.max((F.col("terms") == len(words)).cast("int")).over(Window.partitionBy("key"))
    return rows.withColumn("strict", strict).where((F.col("terms") == len(words)) | (F.col("strict") == 0)).drop("strict")


def rrf(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists by conversation: key, lex_rank, sem_rank, score."""
    both = lexical.select("key", F.col("rank").alias("lex_rank")).join(semantic.select("key", F.col("rank").alias("sem_rank")), "key", "full_outer")
    score = F.coalesce(1.0 / (RRF_K + F.col("lex_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("sem_rank")), F.lit(0.0))
    return both.withColumn("score", score)


def merged(hits: DataFrame) -> DataFrame:
    """One hit for each (key, ordinal, source): ranges unite, scores take their maximum, visibility is any."""
    return hits.groupBy("key", "ordinal", "source").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.bool_or("visible").alias("visible"))


def grouped(hits: DataFrame, groups: int, each: int) -> DataFrame:
    """Best ``groups`` conversations by their best hit, ``each`` hits of them: hits order by tenth of score, score, ordinal."""
    own = Window.partitionBy("key").orderBy(F.floor(F.col("score") * 10).desc(), F.desc("score"), "ordinal")
    rows = hits.withColumn("place", F.row_number().over(own)).withColumn("total", F.count("*").over(Window.partitionBy("key")))
    best = rows.where("place = 1").select("key", F.col("score").alias("group_score")).orderBy(F.desc("group_score"), "key").limit(groups)
    return rows.where(F.col("place") <= each).join(best, "key")


def read_window(messages: DataFrame, focus: DataFrame, radius: int) -> DataFrame:
    """Messages within ``radius`` of each focus (key, focus), once each."""
    near = focus.select("key", F.explode(F.sequence(F.greatest(F.col("focus") - radius, F.lit(1)), F.col("focus") + radius)).alias("ordinal")).distinct()
    return messages.join(near, ["key", "ordinal"])


def budgeted(messages: DataFrame, focus: DataFrame, budget: int) -> DataFrame:
    """Messages around each focus, nearest first (the later one on ties), while their characters fit the budget."""
    rows = messages.join(focus, "key").withColumn("far", F.abs(F.col("ordinal") - F.col("focus")))
    order = Window.partitionBy("key").orderBy("far", F.desc("ordinal"))
    return rows.withColumn("used", F.sum(F.length("text")).over(order)).where((F.col("used") <= budget) | (F.col("far") == 0)).drop("far")


def outline(messages: DataFrame) -> DataFrame:
    """Short conversations message by message, longer ones in steps of ten: key, first, last, chars, snippet."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = messages.withColumn("n", n).withColumn("step", F.when(F.col("n") <= SHORT_OUTLINE, F.col("ordinal") - 1).otherwise(F.floor((F.col("ordinal") - 1) / OUTLINE_STEP)).cast("long"))
    return rows.groupBy("key", "step").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum(F.length("text")).alias("chars"), F.left(one_spaced(F.min_by("text", "ordinal")), F.lit(SNIPPET)).alias("snippet"))


def line_matches(bodies: DataFrame, text: str, context: int) -> DataFrame:
    """Lines of (key, text) that contain ``text``, with ``context`` lines around, once each: key, line, body, hit."""
    lines = bodies.select("key", F.posexplode(F.split("text", "\n")).alias("at", "body")).withColumn("line", F.col("at") + 1).drop("at")
    by = Window.partitionBy("key").orderBy("line").rowsBetween(-context, context)
    return lines.withColumn("hit", F.col("body").contains(text)).withColumn("near", F.max(F.col("hit").cast("int")).over(by)).where("near = 1").drop("near")


def fnv128(parts: list[str]) -> str:
    """FNV-1a over length-prefixed parts, 32 hex digits."""
    h = _FNV_OFFSET
    for p in parts:
        data = p.encode()
        for b in len(data).to_bytes(8, "little") + data:
            h = ((h ^ b) * _FNV_PRIME) % (1 << 128)
    return f"{h:032x}"


@F.pandas_udf(StringType())
def conversation_ref(label: pd.Series, root: pd.Series, native_id: pd.Series) -> pd.Series:
    return pd.Series([fnv128(["conversation", a or "", b or "", c or ""]) for a, b, c in zip(label, root, native_id, strict=True)])


def anchor(*parts: Column) -> Column:
    """``ma_`` and 16 hex digits of the content."""
    return F.concat(F.lit("ma_"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def unique_prefixes(refs: DataFrame, least: int = 12) -> DataFrame:
    """Shortest prefix of each ref that no other shares, ``least`` digits and more. Neighbours decide: refs are dealt to
    ranges by their first two digits, and only the ends of a range look across."""
    ordered = Window.partitionBy(F.left("ref", F.lit(2))).orderBy("ref")
    rows = refs.select("ref").distinct().withColumn("before", F.lag("ref").over(ordered)).withColumn("after", F.lead("ref").over(ordered))

    def common(other: str) -> Column:
        same = F.array_position(F.zip_with(F.split("ref", ""), F.split(other, ""), lambda a, b: (a == b).cast("int")), 0)
        return F.when(F.col(other).isNull(), F.lit(0)).otherwise(same - 1)

    return rows.select("ref", F.left("ref", F.greatest(F.lit(least), common("before") + 1, common("after") + 1).cast("int")).alias("short"))


def parsed_range(text: Column) -> Column:
    """``mN`` or ``mN..mM`` as (first, last, error): messages count from 1, and a range names both its ends in order."""
    first, last = (F.regexp_extract(text, r"^m([0-9]+)(?:\.\.m([0-9]+))?$", k) for k in (1, 2))
    low, high = first.try_cast("bigint"), F.coalesce(F.nullif(last, F.lit("")), first).try_cast("bigint")
    error = (
        F.when(text.contains("..."), "invalid message range; use mN or mN..mM")
        .when(text.startswith("..") | text.endswith(".."), "open-ended message ranges are not supported")
        .when(low.isNull() | high.isNull(), "invalid message ref; expected mN")
        .when((low == 0) | (high == 0), "message refs are 1-based")
        .when(low > high, "message range start must be before end")
    )
    return F.struct(F.when(error.isNull(), low).alias("first"), F.when(error.isNull(), high).alias("last"), error.alias("error"))


def resolved(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """(input, state, n, ref), a row for each row of ``inputs`` (input), against ``refs`` (ref of 32 hex digits): ``ch_`` and 8 digits and more name
    the conversation whose digest starts so. States: found, not found, ambiguous (n candidates), and invalid for anything
    else. Both sides meet by their first 8 digits, so no input meets all refs."""
    digits = F.coalesce(F.lower(F.regexp_extract("input", f"^ch_([0-9A-Fa-f]{{{MIN_REF_DIGITS},{REF_DIGITS}}})$", 1)), F.lit(""))
    asked = inputs.select("input").distinct().withColumn("digits", digits).withColumn("head", F.left("digits", F.lit(MIN_REF_DIGITS)))
    held = refs.select("ref", F.left("ref", F.lit(MIN_REF_DIGITS)).alias("head")).distinct()
    met = asked.join(held, (asked["head"] == held["head"]) & held["ref"].startswith(asked["digits"]), "left")
    rows = met.groupBy("input", "digits").agg(F.count("ref").alias("n"), F.min("ref").alias("ref"))
    state = F.when(F.col("digits") == "", "invalid").when(F.col("n") == 0, "not found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    found = rows.select(F.col("input").alias("of"), state.alias("state"), "n", F.when(F.col("n") == 1, F.col("ref")).alias("ref"))
    return inputs.join(found, F.col("input").eqNullSafe(F.col("of"))).select("input", "state", "n", "ref")


# How references are written, and what is said of those that are not (fixed values).
UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
TOO_SHORT, TOO_LONG, NOT_HEX = f"conversation ref is too short; use at least {MIN_REF_DIGITS} hex characters", f"conversation ref is too long; use at most {REF_DIGITS} hex characters", "conversation ref must contain hexadecimal digits"
OTHER_FORM = "use a full UUID, UUID-based session basename/filename (not a path), or ref=ch_... from agent output"


def reference_form(text: Column) -> Column:
    """(form, value, error) of a reference: ``digest`` (its start, in small letters), ``uuid`` (in small letters), ``file`` (a
    name without its ending that is a UUID or ends in _ and one), or an error."""
    digits = F.substring(text, 4, F.length(text))
    digest, uuid, file = (text.rlike(p) for p in (rf"\Ach_[0-9A-Fa-f]{{{MIN_REF_DIGITS},{REF_DIGITS}}}\z", rf"\A{UUID}\z", rf"\A(?:[^/\\]+_)?{UUID}(?:\.jsonl)?\z"))
    right = F.when(digest, F.struct(F.lit("digest").alias("form"), F.lower(digits).alias("value"))).when(uuid, F.struct(F.lit("uuid").alias("form"), F.lower(text).alias("value"))).when(file, F.struct(F.lit("file").alias("form"), F.regexp_replace(text, r"\.jsonl$", "").alias("value")))
    wrong = F.when(~text.startswith("ch_"), OTHER_FORM).when(F.octet_length(digits) < MIN_REF_DIGITS, TOO_SHORT).when(F.octet_length(digits) > REF_DIGITS, TOO_LONG).otherwise(NOT_HEX)
    return F.struct(right["form"].alias("form"), right["value"].alias("value"), F.when(~(digest | uuid | file), wrong).alias("error"))


def resolved_refs(inputs: DataFrame, keys: DataFrame) -> DataFrame:
    """(input, state, error, n, key, candidates) of references (input) against conversations (key, ref, legacy_ref, uuid, file). A
    digest that no ref begins with is looked for among the refs of old. States: found, not found, ambiguous (with the
    candidates' refs in order) and invalid. The three forms are three equi-joins; digests meet by their first digits."""
    asked = inputs.select("input").distinct().withColumn("f", reference_form(F.col("input"))).select("input", "f.*")
    held = keys.select("key", "ref", "legacy_ref", F.lower("uuid").alias("uuid"), F.regexp_extract("file", r"^(.*)\.jsonl$", 1).alias("stem"))
    head = F.left("value", F.lit(MIN_REF_DIGITS)).alias("head")

    def by_digest(column: str) -> DataFrame:
        rows = held.select("key", "ref", F.col(column).alias("full"), F.left(column, F.lit(MIN_REF_DIGITS)).alias("head"))
        return asked.where("form = 'digest'").select("input", "value", head).join(rows, "head").where("startswith(full, value)").select("input", "key", "ref")

    direct = by_digest("ref")
    old = by_digest("legacy_ref").join(direct.select("input").distinct(), "input", "left_anti")
    named = [asked.where(f"form = '{form}'").select("input", F.col("value").alias(column)).join(held.select("key", "ref", column), column).select("input", "key", "ref") for form, column in (("uuid", "uuid"), ("file", "stem"))]
    met = direct.unionByName(old).unionByName(named[0]).unionByName(named[1]).groupBy("input").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.sort_array(F.collect_list("ref")).alias("candidates"))
    rows = asked.join(met, "input", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("error").isNotNull(), "invalid").when(F.col("n") == 0, "not found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return rows.select("input", state.alias("state"), "error", "n", F.when(F.col("n") == 1, F.col("key")).alias("key"), F.when(F.col("n") > 1, F.col("candidates")).alias("candidates"))


def match_steps(lines: DataFrame, text: str) -> DataFrame:
    """(key, line, next, previous) of the lines of (key, line, body) that contain ``text`` in any case; the last leads to the
    first and the first to the last."""
    found = lines.where(F.lower("body").contains(text.lower())).select("key", "line")
    by = Window.partitionBy("key").orderBy("line")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.select("key", "line", F.coalesce(F.lead("line").over(by), F.first("line").over(whole)).alias("next"), F.coalesce(F.lag("line").over(by), F.last("line").over(whole)).alias("previous"))


def literal_context(body: Column, text: str, around: int = 80) -> Column:
    """The first place of a quoted text with ``around`` characters on both sides; null where it does not stand."""
    at = F.instr(body, text)
    low = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(body, low, at + len(text) + around - low))
