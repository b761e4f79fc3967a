"""Where search words and quoted texts stand in a text as it was written: places in UTF-8 bytes.

Words are looked for in the normalised form, in which a character may become none, one or several; each of its characters
knows the one it came from, so a match is told as whole characters of the text. Texts are in NFC, as they are stored.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.query import Literal
from palaver.functions.text import at_word_start, normalize, quote, starts_word

RANGES = "array<struct<start:int,end:int>>"


class Spanned:
    """A text, its normalised form and its form in lower case, each with the way back to the text's bytes."""

    def __init__(self, raw: str) -> None:
        self.raw = raw
        self.norm, self._norm_of = _with_origins(raw, normalize)
        self._starts = None if raw.isascii() else [0, *accumulate(len(c.encode()) for c in raw)]

    def _bytes(self, first: int, last: int) -> tuple[int, int]:
        """Of the characters first..last."""
        return (first, last + 1) if self._starts is None else (self._starts[first], self._starts[last + 1])

    def words(self, word: str, anywhere: bool = False) -> list[tuple[int, int]]:
        """Ranges of a normalised word at word starts, or anywhere; they do not overlap."""
        found, at = [], self.norm.find(word) if word else -1
        while at >= 0:
            hit = anywhere or starts_word(self.norm, at)
            if hit:
                found.append(self._bytes(self._norm_of[at], self._norm_of[at + len(word) - 1]))
            at = self.norm.find(word, at + (len(word) if hit else 1))
        return found

    def literals(self, literal: Literal) -> list[tuple[int, int]]:
        """Ranges of a quoted text that begin at word starts; without capitals each character is compared in lower case, and
        the last may be matched in part."""
        text, of = (self.raw, range(len(self.raw))) if literal.sensitive else _with_origins(self.raw, str.lower)
        wanted = literal.text if literal.sensitive else "".join(c.lower() for c in literal.text)
        found, at = [], text.find(wanted) if wanted else -1
        while at >= 0:
            first, last = of[at], of[at + len(wanted) - 1]
            hit = (at == 0 or of[at - 1] != first) and starts_word(self.raw, first)
            if hit:
                found.append(self._bytes(first, last))
            after = at + 1
            while hit and after < len(text) and of[after] <= last:
                after += 1
            at = text.find(wanted, after)
        return found


def _with_origins(raw: str, form) -> tuple[str, list[int] | range]:
    """The text character by character in a form, and for each of its characters the index of the one it came from."""
    if raw.isascii():
        return form(raw), range(len(raw))
    out, of, last = [], [], ""
    for k, c in enumerate(raw):
        made = form(c)
        if form is normalize and c == "̇" and last in ("i", "j"):
            made, last = "", c  # what folding drops after an i or j
        else:
            last = made[-1:]
        out.append(made)
        of += [k] * len(made)
    return "".join(out), of


def query_ranges(words: list[str], anywhere: bool = False):
    """A column function: the ranges of all words in a text, in order."""

    @F.pandas_udf(RANGES)
    def run(texts: pd.Series) -> pd.Series:
        def of(text: str | None):
            if not isinstance(text, str):
                return None
            spanned = Spanned(text)
            return [{"start": a, "end": b} for a, b in sorted({r for w in words for r in spanned.words(w, anywhere)})]

        return texts.map(of)

    return run


def literal_pattern(literal: Literal) -> str:
    """A Java pattern of a quoted text at a word start. Without capitals each of its characters stands for those whose lower
    case it is."""
    if literal.sensitive:
        return at_word_start(literal.text)
    return at_word_start(literal.text, "".join(_any_case(c) for c in literal.text))


def _any_case(c: str) -> str:
    upper = [u for u in {c, c.upper(), c.title(), *({"k": "K", "å": "Å", "ω": "Ω"}.get(c, ""),)} if len(u) == 1 and u.lower() == c]
    return quote(c) if len(upper) < 2 else "[" + "".join(sorted(upper)) + "]"


def literal_span(text: Column, literal: Literal) -> tuple[Column, Column, Column]:
    """(whether it stands in the text, its first byte, the end of its last): what lies before the first and behind the last
    match tells both."""
    parts = F.split(text, literal_pattern(literal), -1)
    return F.size(parts) > 1, F.octet_length(F.element_at(parts, 1)), F.octet_length(text) - F.octet_length(F.element_at(parts, -1))
