"""Snippets: where the terms of a query stand in a text beyond what its preview shows, clustered, covered and cut to excerpts.

Offsets are UTF-8 bytes of the text. Whether a preview hides something is told by expressions (``hides``); clusters need an
order and a running span, so they are a small fold in an Arrow function, run on the few rows of a ranked page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.query import Literal, Query, parse
from palaver.functions.spans import Spanned, literal_pattern
from palaver.functions.text import at_word_start, has_cjk, kind_of, quote

# Characters around a cluster, bytes between its hits, its bytes, clusters, terms, the sign for what is left out.
WINDOW, GAP, SPAN, CLUSTERS, TERMS, ELIDED = 1024, 50, 200, 3, 64, "…"
_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

Hit = tuple[int, int, int]


@dataclass(frozen=True)
class Term:
    """A normalised word, or a quoted text."""

    word: str = ""
    literal: Literal | None = None
    anywhere: bool = False

    def hits(self, text: Spanned) -> list[tuple[int, int]]:
        return text.literals(self.literal) if self.literal else text.words(self.word, self.anywhere)


def terms_of(query: str | Query) -> list[Term]:
    """Words, names with an underscore and quoted texts, those that differ by ASCII case only once, 64 at most."""
    q = parse(query) if isinstance(query, str) else query
    anywhere = any(map(has_cjk, q.words))
    names = [x for x in q.literals if x.text in q.unquoted.split()]
    quoted = [x for x in q.literals if x not in names]
    out: dict[tuple[str, bool], Term] = {}
    for t in [*[Term(w, anywhere=anywhere) for w in q.words], *[Term(literal=x) for x in (*names, *quoted)]]:
        out.setdefault(((t.literal.text if t.literal else t.word).translate(_ASCII), bool(t.literal)), t)
    return list(out.values())[:TERMS]


def term_hits(text: Spanned, terms: list[Term]) -> list[Hit]:
    """(start, end, term) of all terms, in order."""
    return sorted((a, b, k) for k, t in enumerate(terms) for a, b in t.hits(text))


def hides(text: Column, norm: Column, preview: Column, preview_norm: Column, query: str | Query) -> Column:
    """Whether a text shows a term that its preview lacks, or more hits than it."""

    def count(t: Term, raw: Column, folded: Column) -> Column:
        if t.literal:
            return F.regexp_count(raw, F.lit(literal_pattern(t.literal)))
        return F.regexp_count(folded, F.lit(quote(t.word) if t.anywhere else at_word_start(t.word)))

    terms = terms_of(query)
    if not terms:
        return F.lit(False)
    whole, shown = [count(t, text, norm) for t in terms], [count(t, preview, preview_norm) for t in terms]
    lacks = reduce(lambda a, b: a | b, [s == 0 for s in shown])
    in_text, in_preview = (reduce(lambda a, b: a + b, c) for c in (whole, shown))
    # clusters without a missing term go, so a lacking term has to stand in the text
    held = reduce(lambda a, b: a | b, [(s == 0) & (w > 0) for s, w in zip(shown, whole, strict=True)])
    return F.coalesce(F.when(lacks, held).otherwise(in_text > in_preview), F.lit(False))


def clusters(hits: list[Hit], text: str | None = None, missing: set[int] | None = None) -> list[tuple[int, int]]:
    """Up to three ranges, in text order: hits no more than 50 bytes apart join up to a span of 200. ``missing`` are the terms
    that a preview lacks (all, unless told); while there are some, clusters without them do not count. First come clusters
    with more of them, more terms side by side (nothing but signs between), more terms, shorter, earlier: those that add a
    missing term, then the rest."""
    missing = {k for *_, k in hits} if missing is None else missing
    groups: list[list[Hit]] = []
    ends: list[int] = []
    for h in hits:
        if groups and h[0] <= ends[-1] + GAP and max(ends[-1], h[1]) - groups[-1][0][0] <= SPAN:
            groups[-1].append(h)
            ends[-1] = max(ends[-1], h[1])
        else:
            groups.append([h])
            ends.append(h[1])
    data = text.encode() if text is not None else b""

    def beside(a: Hit, b: Hit) -> bool:
        between = data[a[1] : b[0]].decode() if a[2] != b[2] and a[1] < b[0] else ""
        return bool(between) and all(kind_of(c) == "sign" for c in between)

    pool = [(frozenset(k for *_, k in g), sum(beside(a, b) for a, b in zip(g, g[1:], strict=False)), g[0][0], end) for g, end in zip(groups, ends, strict=True)]
    pool = sorted((p for p in pool if not missing or p[0] & missing), key=lambda p: (-len(p[0] & missing), -p[1], -len(p[0]), p[3] - p[2], p[2]))
    picked, met = [], set()
    for p in pool:
        if len(picked) < CLUSTERS and (p[0] & missing) - met:
            picked.append(p)
            met |= p[0] & missing
    picked += [p for p in pool if p not in picked][: CLUSTERS - len(picked)]
    return sorted((p[2], p[3]) for p in picked)


def chosen(text: Spanned, preview: str, terms: list[Term]) -> list[tuple[int, int]] | None:
    """The ranges to show of a text, or None where its preview shows all there is."""
    hits = term_hits(text, terms)
    shown = term_hits(Spanned(preview), terms)
    missing = set(range(len(terms))) - {k for *_, k in shown}
    if not hits or (not missing and len(hits) <= len(shown)):
        return None
    return clusters(hits, text.raw, missing) or None


def excerpt(text: str, ranges: list[tuple[int, int]], window: int = WINDOW) -> tuple[str, list[tuple[int, int]]]:
    """The text around ranges, ``window`` characters to each side, windows that meet as one, and the ranges inside it."""
    data = text.encode()
    spans: list[list[int]] = []
    for a, b in ranges:
        low = a - len(data[:a].decode()[-window:].encode()) if window else a
        high = b + len(data[b : b + 4 * window].decode(errors="ignore")[:window].encode())
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    out, places, done = b"", [], 0
    for low, high in spans:
        out += ELIDED.encode() if low > done else b""
        places += [(a - low + len(out), b - low + len(out)) for a, b in ranges if low <= a and b <= high]
        out += data[low:high]
        done = high
    return (out + (ELIDED.encode() if done < len(data) else b"")).decode(), places


EVIDENCE = "struct<text:string,ranges:array<struct<start:int,end:int>>,shown:array<struct<start:int,end:int>>>"


def _row(text: str | None, preview: str | None, terms: list[Term], window: int) -> tuple:
    spanned = Spanned(text) if isinstance(text, str) and terms else None
    own = chosen(spanned, preview if isinstance(preview, str) else "", terms) if spanned else None
    if not own:
        return None, None, None
    cut, places = excerpt(text, own, window)
    return cut, *([{"start": a, "end": b} for a, b in x] for x in (own, places))


def against(query: str | Query, window: int = WINDOW) -> Callable:
    """A column function of a text and its preview: the excerpt that shows what the preview does not, its ranges in the text
    and in the excerpt; null where there is nothing more to show."""
    terms = terms_of(query)

    @F.pandas_udf(EVIDENCE)
    def run(texts: pd.Series, previews: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t, p, terms, window) for t, p in zip(texts, previews, strict=True)], columns=["text", "ranges", "shown"])

    return run


def evidence(words: list[str], window: int = WINDOW) -> Callable:
    """A column function: a text to its excerpt for normalised words and the ranges behind it; null if none is there."""
    terms = [Term(w, anywhere=any(map(has_cjk, words))) for w in words]

    @F.pandas_udf(EVIDENCE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t, "", terms, window) for t in texts], columns=["text", "ranges", "shown"])

    return run
