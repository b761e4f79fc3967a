"""Passages and vectors: turn filter, chunks, content-hash cache, cosine and overlap ranking, quality."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palaver.functions.query import Literal
from palaver.functions.text import at_word_start, normalize, normalized, one_spaced, stripped
from palaver.operators.lexical import literal_matches

TARGET_BYTES, OVERLAP_BYTES = 2400, 300
CORE_MOST = 50_000
OVERLAP_BONUS = 0.2
QUALITY = [(0.85, "strong"), (0.65, "good"), (0.35, "fair")]

# Fixed values of the turn filter.
SPAN_TAGS = ["system-reminder", "local-command-caveat", "local-command-stdout", "command-message", "command-name"]
VALIDATION_TERMS = ["validation passed", "all checks pass", "working tree clean", "committed", "commit:", "validation:"]
COMMAND_TERMS = ["cargo test", "just check", "git status", "git diff"]
CODE_MARKS = ["::{", "=>", "</", "<div", "function ", "const ", "let ", "fn "]
BOX_SIGNS = "─━│┃┌┐└┘├┤┬┴┼╭╮╰╯═║╔╗╚╝"


def _length_of(block: Column, signs: str) -> Column:
    return F.regexp_count(block, F.lit(signs))


def _is_artifact(block: Column) -> Column:
    """Drawn boxes, tables and code rather than prose."""
    solid, boxes, rules, letters = (_length_of(block, p) for p in (r"(?U)\S", f"[{BOX_SIGNS}]", r"[|\-+=_`]", r"[\p{IsAlphabetic}\p{N}]"))
    drawn = (boxes * 4 >= solid) | ((boxes >= 3) & (solid <= 24))
    code = _any([block.contains(m) for m in CODE_MARKS]) & (rules > F.floor(letters / 4))
    return (solid == 0) | drawn | ((rules * 2 > letters) & block.contains("|")) | code


def _is_status(block: Column) -> Column:
    low = F.lower(block)
    return _any([low.contains(t) for t in VALIDATION_TERMS]) & _any([low.contains(t) for t in COMMAND_TERMS])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filtered_turn(text: Column, role: Column | None = None) -> Column:
    """Prose of a turn; empty where nothing is left. A slash command gives its arguments; fenced code goes (an open fence
    drops the rest), tag spans go (an open tag drops the tag only); of the blocks between drawn signs those go that are
    commands, drawings, tables or code, and, where ``role`` says assistant, reports of checks."""
    called = text.contains("<command-name>") & text.contains("</command-name>")
    args = stripped(F.regexp_extract(text, "(?s)<command-args>(.*?)</command-args>", 1))
    text = F.when(called & (args != ""), args).otherwise(text)
    text = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "")
    for tag in SPAN_TAGS:
        text = F.regexp_replace(text, rf"(?s)<{tag}>(?:.*?</{tag}>)?", "")
    blocks = F.transform(F.regexp_extract_all(one_spaced(text), F.lit(f"[{BOX_SIGNS}]+|[^{BOX_SIGNS}]+"), 0), lambda b: F.trim(b))

    def kept(b: Column) -> Column:
        low_value = b.startswith("/") | _any([b.contains(f"<{t}>") | b.contains(f"</{t}>") for t in SPAN_TAGS])
        status = F.lit(False) if role is None else (role == "assistant") & _is_status(b)
        return (b != "") & ~low_value & ~status & ~_is_artifact(b)

    return one_spaced(F.array_join(F.filter(blocks, kept), " "))


def holding_literals(passages: DataFrame, literals: list[Literal]) -> DataFrame:
    """Passages (with ``text``) that hold every quoted text; a filter before the ranking."""
    return passages.where(reduce(lambda a, b: a & b, [literal_matches(F.col("text"), x) for x in literals], F.lit(True)))


def heaviest(passages: DataFrame, top: int = 10) -> DataFrame:
    """(key, chunks) of the conversations with most passages."""
    return passages.groupBy("key").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "key").limit(top)


def _cut(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def pack_turns(turns: list[tuple[int, str]], target: int = TARGET_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int, str]]:
    """(first, last ordinal, text) passages: turns join while they fit ``target`` bytes; a new passage may begin with the
    turn before it if that is short; a turn over the target goes in overlapping parts."""
    out: list[tuple[int, int, str]] = []
    now, first, last = "", 0, 0
    for k, (ordinal, raw) in enumerate(turns):
        text = raw.strip()
        size = len(text.encode())
        if not text:
            continue
        if size > target:
            if now:
                out.append((first, last, now))
                now = ""
            data = text.encode()
            while data:
                if len(data) <= target:
                    out.append((ordinal, ordinal, data.decode()))
                    break
                end = _cut(data, target)
                out.append((ordinal, ordinal, data[:end].decode()))
                data = data[_cut(data, max(0, end - overlap)) :].decode().lstrip().encode()
            continue
        if now and len(now.encode()) + 2 + size > target:
            out.append((first, last, now))
            now = ""
            before = turns[k - 1][1].strip()
            if before and len(before.encode()) <= overlap:
                now, first, last = before, turns[k - 1][0], turns[k - 1][0]
        now, first, last = (f"{now}\n\n{text}", first, ordinal) if now else (text, ordinal, ordinal)
    if now:
        out.append((first, last, now))
    return out


def chunks(turns: DataFrame) -> DataFrame:
    """(key, chunk, first, last, text) passages of (key, ordinal, text); one conversation at a time, in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        rows = pack_turns(list(zip(pdf["ordinal"], pdf["text"].fillna(""), strict=True)))
        rows = [(f, last, re.sub(r"\s+", " ", t).strip()) for f, last, t in rows]
        return pd.DataFrame([(pdf["key"].iloc[0], i, f, last, t) for i, (f, last, t) in enumerate(rows) if t], columns=["key", "chunk", "first", "last", "text"])

    return turns.select("key", "ordinal", "text").groupBy("key").applyInPandas(fold, "key long, chunk int, first int, last int, text string")


def hashing_embedder(dim: int = 64) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A deterministic embedder for use without a model: signed hashes of words, unit length."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim, dtype=np.float32)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                norm = float(np.linalg.norm(v))
                out.append((v / norm if norm else v).tolist())
            yield pd.Series(out)

    return embed


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_split(passages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages whose text_hash the cache holds with its embedding, distinct missing hashes)."""
    hits = passages.join(cache.select("text_hash", "embedding"), "text_hash")
    return hits, passages.select("text_hash").distinct().join(cache, "text_hash", "left_anti")


def embed_missing(passages: DataFrame, cache: DataFrame, embedder: Callable | None = None, budget: int | None = None) -> DataFrame:
    """New cache rows (text_hash, embedding): each missing text once, ``budget`` texts at most."""
    embed = F.pandas_udf(embedder or hashing_embedder(), "array<float>")
    missing = passages.select("text_hash", "text").dropDuplicates(["text_hash"]).join(cache, "text_hash", "left_anti")
    return (missing.limit(budget) if budget is not None else missing).select("text_hash", embed("text").alias("embedding"))


def pruned(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows to keep: protected first, then used last."""
    return cache.orderBy(F.desc("protected"), F.desc("last_used"), "text_hash").limit(most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when a length is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def overlap(text: Column, words: list[str]) -> Column:
    """0.2 for all words as substrings in lower case, a share for some."""
    low = F.lower(text)
    return F.lit(OVERLAP_BONUS / max(len(words), 1)) * sum((low.contains(w).cast("int") for w in words), F.lit(0))


def quality(score: Column) -> Column:
    out = F.lit("weak")
    for least, name in reversed(QUALITY):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def best_per_conversation(scored: DataFrame) -> DataFrame:
    """The best passage of each key of (key, chunk, hybrid, semantic, lexical)."""
    best = F.max_by(F.struct("chunk", "semantic", "lexical"), F.struct("hybrid", "semantic", "lexical", -F.col("chunk"))).alias("b")
    return scored.groupBy("key").agg(F.max("hybrid").alias("hybrid"), best).select("key", "hybrid", "b.chunk", "b.semantic", "b.lexical")


def refresh(resident: DataFrame, current: DataFrame) -> DataFrame:
    """(key, action) of two states of (key, mark): keep what did not change, embed what is new or changed, drop what is gone."""
    both = resident.select("key", F.col("mark").alias("old")).join(current.select("key", F.col("mark").alias("new")), "key", "full_outer")
    return both.select("key", F.when(F.col("new").isNull(), "drop").when(F.col("old") == F.col("new"), "keep").otherwise("embed").alias("action"))


def core(passages: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct texts of a cache's protected core, all of them; with ``most`` (``CORE_MOST`` is what one person's cache holds)
    it is an error if there are more, and the count stops there."""
    texts = passages.where("text is not null").select(content_key(F.col("text")).alias("text_hash")).distinct()
    if most is not None and texts.limit(most + 1).count() > most:
        raise ValueError(f"the core holds more than {most} passages")
    return texts


def _flaw(dim: int) -> Column:
    """Why a vector can not stand in a table of ``dim`` components; null where it can."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != dim, F.concat(F.size("embedding").cast("string"), F.lit(f" components, not {dim}"))).when(~F.coalesce(whole, F.lit(False)), "not finite")


def refused(cache: DataFrame, dim: int) -> DataFrame:
    """(text_hash, reason) of the rows that ``matrix`` leaves out, for a caller that takes only whole caches."""
    return cache.select("text_hash", _flaw(dim).alias("reason")).where("reason is not null")


def matrix(cache: DataFrame, dim: int) -> DataFrame:
    """The rows of an embedding table: one for each text_hash, in ranges and sorted by it, so a lookup skips files. Vectors of
    another length or with null or non-finite parts are left out; ``refused`` names them."""
    one = cache.where(_flaw(dim).isNull()).groupBy("text_hash").agg(F.max("embedding").alias("embedding"))
    return one.repartitionByRange("text_hash").sortWithinPartitions("text_hash")


# -- passages of tools and subagents ----------------------------------------------------------------------------------
#: Names of the six kinds of agent passages, by (of a subagent, kind of part).
AGENT_SOURCES = {(False, "dialogue"): "dialogue", (False, "tool"): "tool", (False, "thinking"): "thinking", (True, "dialogue"): "subagent-dialogue", (True, "tool"): "subagent-tool", (True, "thinking"): "subagent-thinking"}
#: Words that say nothing of a tool's text (fixed values).
STOP_WORDS = "after all an and are as at be before but by can do does for from has have how if in is it its my no not of on or our so than that the them then they this to up was we what when where which why with would you your".split()


def spaced_case(text: Column) -> Column:
    """A space between a small letter and a capital."""
    return F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")


def tool_terms(query: str) -> list[str]:
    """The distinct words of a query that tool texts are looked through for: normalised, without signs at their ends, of two
    characters and more."""
    words = normalize(re.sub(r"([a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", r"\1 ", query)).split()
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in words]
    return list(dict.fromkeys(w for w in bare if len(w) > 1 and w not in STOP_WORDS))


@F.pandas_udf(ArrayType(StringType()))
def byte_segments(texts: pd.Series, most: pd.Series) -> pd.Series:
    """A text in parts of at most so many bytes, no character cut (one at least a part)."""

    def cut(text: str | None, n: int) -> list[str] | None:
        if text is None:
            return None
        data, out, at = text.encode(), [], 0
        while at < len(data):
            end = _cut(data, at + n) if at + n < len(data) else len(data)
            if end <= at:  # a character larger than a part
                end = at + len(data[at : at + 4].decode(errors="ignore")[:1].encode())
            out.append(data[at:end].decode())
            at = end
        return out

    return pd.Series([cut(t, int(n)) for t, n in zip(texts, most, strict=True)])


def agent_passages(segments: DataFrame, query: str | None = None, most: int = TARGET_BYTES) -> DataFrame:
    """(key, ordinal, part, source, segment, text): passages of (key, ordinal, part, source, subagent, text), six kinds in all. A
    tool's text gives each of its segments a passage of its own; with a query it gives the one that holds most of the
    query's terms (the last of equals), where that holds one, or two of three and more."""
    kind = F.coalesce(*[F.when((F.col("subagent") == sub) & (F.col("source") == part), F.lit(name)) for (sub, part), name in AGENT_SOURCES.items()])
    rows = segments.select("key", "ordinal", "part", kind.alias("source"), F.col("source").alias("of"), "text").where("source is not null")
    tools = rows.where("of = 'tool'").select("key", "ordinal", "part", "source", F.posexplode(byte_segments(F.col("text"), F.lit(most))).alias("segment", "text"))
    if query is not None:
        terms = tool_terms(query)
        tools = tools.withColumn("norm", normalized(spaced_case(F.col("text"))))
        met = sum((F.col("norm").rlike(at_word_start(t)).cast("int") for t in terms), F.lit(0))
        tools = tools.withColumn("met", met).where(F.col("met") >= (2 if len(terms) >= 3 else 1))
        best = F.max_by(F.struct("segment", "text"), F.struct("met", "segment")).alias("b")
        tools = tools.groupBy("key", "ordinal", "part", "source").agg(best).select("key", "ordinal", "part", "source", "b.segment", "b.text")
    said = rows.where("of <> 'tool'").select("key", "ordinal", "part", "source", F.lit(0).alias("segment"), "text")
    both = tools.unionByName(said).withColumn("text", stripped(F.col("text")))
    return both.where("text <> ''")
