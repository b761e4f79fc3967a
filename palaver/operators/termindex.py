"""An inverted index of word starts: terms with capped counts by document, sorted by term, looked up by prefix range.

A term is a run of letters or of digits cut to 24 characters. A search word is looked up by its first run, cut alike; where
that is not the whole word, the documents found are a superset, and their normalised text decides.
"""

from __future__ import annotations

import unicodedata
from datetime import datetime
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.query import parse
from palaver.functions.text import at_word_start, count_at_word_start, has_cjk, normalize
from palaver.operators import lexical

TERM_CHARS, TF_CAP = 24, 10
#: The fields in which the search gate accepts a word.
SEARCHED = ("body_norm", "project_norm")


def terms(docs: DataFrame, fields: tuple[str, ...] = ("body_norm",)) -> DataFrame:
    """(term, key, tf) of key and normalised fields: each word from its start, cut to a bounded length."""
    found = [F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(r"\p{L}+|\p{N}+"), 0) for f in fields]
    words = docs.select("key", F.explode(F.concat(*found)).alias("word"))
    return words.groupBy(F.left("word", F.lit(TERM_CHARS)).alias("term"), "key").agg(F.least(F.count("*"), F.lit(TF_CAP)).alias("tf"))


def write_index(docs: DataFrame, path: str, files: int | None = None, fields: tuple[str, ...] = ("body_norm",), file_bytes: int = 1 << 26) -> None:
    """Ranges of (term, key), sorted: a prefix lookup skips files and row groups by their statistics, and a frequent term is
    many files. There is a file for each ``file_bytes`` of text unless told otherwise."""
    if files is None:
        size = docs.agg(sum((F.coalesce(F.sum(F.octet_length(f)), F.lit(0)) for f in fields), F.lit(0))).first()[0]
        files = max(4, -(-size // file_bytes))
    terms(docs, fields).repartitionByRange(files, "term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(path)


def looked_up(word: str) -> str:
    """What of a word the terms can answer: its first run of letters or of digits, cut as terms are."""
    kind = unicodedata.category(word[0])[0]
    return "".join(takewhile(lambda c: unicodedata.category(c)[0] == kind, word))[:TERM_CHARS] if kind in "LN" else ""


def successor(prefix: str) -> str:
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def _in_terms(index: DataFrame, start: str) -> DataFrame:
    hit = index.where((F.col("term") >= start) & (F.col("term") < successor(start)))
    return hit.groupBy("key").agg(F.least(F.sum("tf"), F.lit(TF_CAP)).alias("tf"))


def prefix_tf(index: DataFrame, prefix: str, docs: DataFrame | None = None, fields: tuple[str, ...] = ("body_norm",)) -> DataFrame:
    """(key, tf) of words that start with ``prefix``; the range reaches the scan. A prefix that terms cannot answer whole
    is counted in the ``fields`` of ``docs``, the indexed ones, at the keys that its start finds."""
    start = looked_up(prefix)
    if start == prefix:
        return _in_terms(index, prefix)
    if docs is None:
        raise ValueError(f"terms hold {start!r} of {prefix!r}: pass the documents")
    may = docs.join(_in_terms(index, start).select("key"), "key", "left_semi") if start else docs
    tf: Column = reduce(lambda a, b: a + b, [count_at_word_start(F.coalesce(f, F.lit("")), prefix, TF_CAP) for f in fields])
    return may.select("key", F.least(tf, F.lit(TF_CAP)).cast("long").alias("tf")).where("tf > 0")


def candidates(index: DataFrame, words: list[str], docs: DataFrame | None = None, fields: tuple[str, ...] = ("body_norm",)) -> DataFrame:
    """Keys that hold every word: one semi-join a word, the longest (rarest) first. Words that terms cannot answer whole are
    looked for in the ``fields`` of ``docs`` at the keys that are left, in one reading."""
    starts = sorted(filter(None, map(looked_up, words)), key=len, reverse=True)
    found = None
    for w in starts:
        keys = _in_terms(index, w).select("key")
        found = keys if found is None else found.join(keys, "key", "left_semi")
    open_ = [w for w in words if looked_up(w) != w]
    if not open_:
        return found
    if docs is None:
        raise ValueError(f"terms do not hold the whole of {open_}: pass the documents")
    may = docs if found is None else docs.join(found, "key", "left_semi")
    for w in open_:
        may = may.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f).rlike(at_word_start(w)), F.lit(False)) for f in fields]))
    return may.select("key")


def merged(base: DataFrame, delta: DataFrame, dead: DataFrame) -> DataFrame:
    """A base index without dead keys, and a delta."""
    return base.join(dead.select("key").distinct(), "key", "left_anti").select(*base.columns).unionByName(delta)


def short_prefixes(index: DataFrame, most: int = 2) -> DataFrame:
    """(prefix, key, tf) of the starts of terms of one to ``most`` bytes: answers for short words, whose ranges hold much of
    the index."""
    starts = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length("term"))), lambda n: F.left("term", n)), lambda p: F.octet_length(p) <= most)
    rows = index.select(F.explode(starts).alias("prefix"), "key", "tf")
    return rows.groupBy("prefix", "key").agg(F.least(F.sum("tf"), F.lit(TF_CAP)).cast("long").alias("tf"))


def search(index: DataFrame, prepared: DataFrame, text: str, now: datetime, top: int | None = None) -> DataFrame:
    """The rows and scores of ``lexical.search`` by way of an index over ``SEARCHED``: documents that hold the terms of every
    word, quoted ones too, are read and ranked; a query without such words, or with CJK text, is a scan."""
    q = parse(text)
    words = [*q.words, *(w for x in q.literals for w in normalize(x.text).split())]
    terms_ = sorted(filter(None, map(looked_up, words)), key=len, reverse=True)
    if not terms_ or any(map(has_cjk, words)):
        return lexical.search(prepared, q, now, top)
    return lexical.search(prepared.join(candidates(index, terms_), "key", "left_semi"), q, now, top)
