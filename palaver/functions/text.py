"""Text scalars: search normalisation, word starts, white space, tags, escapes.

Column helpers stay in the JVM. Normalisation alone needs full Unicode case folding and NFC, which Spark has no built-in
for; it is an Arrow function, meant to run once when text is stored, with a fast path for ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: CJK and typographic punctuation that separates words, besides white space and _ - / (fixed values).
PUNCTUATION = "　、。〈〉《》「」『』【】〔〕〖〗！（），：；？“”‘’—…·"
_SEPARATOR = re.compile(f"[\\s_/\\-{PUNCTUATION}]")
_ALPHABETIC = regex.compile(r"\p{Alphabetic}")
#: Classes of Java patterns. Each names a character beyond 16 bits of its own kind: without one Java looks back by half of such.
LETTER, DIGIT = "[\\p{IsAlphabetic}\U00010000&&[^\\p{N}]]", "[\\p{N}\U00010107]"
_SPECIAL = set("\\^$.|?*+()[]{}")


def fold(text: str) -> str:
    """Full case folding; a capital I with a dot becomes i, and a combining dot after a folded i or j goes."""
    folded = text.replace("İ", "i").casefold()
    return re.sub("(?<=[ij])̇", "", folded)


def normalize(text: str) -> str:
    """NFC, separators to spaces, full case folding."""
    if text.isascii():
        return _SEPARATOR.sub(" ", text).lower()
    return fold(_SEPARATOR.sub(" ", unicodedata.normalize("NFC", text)))


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """``normalize`` of a column; null stays null."""
    return texts.map(normalize, na_action="ignore")


def quote(word: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in word)


def kind_of(c: str) -> str:
    """digit (any number sign), letter (alphabetic otherwise) or sign."""
    if unicodedata.category(c)[0] == "N":
        return "digit"
    return "letter" if _ALPHABETIC.match(c) else "sign"


def starts_word(text: str, at: int) -> bool:
    """Whether a word starts at a place: after nothing, after a sign, or where letters and digits meet."""
    before = kind_of(text[at - 1]) if at else "sign"
    return before == "sign" or kind_of(text[at]) not in ("sign", before)


def at_word_start(word: str, body: str | None = None) -> str:
    """A pattern of ``word`` where a word starts: after nothing, after a sign, or where letters and digits meet."""
    kind = kind_of(word[0])
    if kind == "digit":
        before = f"(?<!{DIGIT})"
    elif kind == "letter":
        before = f"(?<!{LETTER})"
    else:
        before = f"(?<!{LETTER}|{DIGIT})"
    return before + (quote(word) if body is None else body)


def count_at_word_start(text: Column, word: str, most: int) -> Column:
    """Occurrences at word starts, one after the other, ``most`` at most."""
    return F.least(F.regexp_count(text, F.lit(at_word_start(word))), F.lit(most))


def has_cjk(text: str) -> bool:
    return any("一" <= c <= "鿿" for c in text)


def one_spaced(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    """White space of any kind at both ends removed."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of whole characters within ``most`` UTF-8 bytes: a cut inside a character moves back, three bytes
    at the most."""
    data = F.encode(text, "UTF-8")
    starts = [F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(most, max(most - 4, -1), -1)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*starts))


def without_structure(text: Column) -> Column:
    """Excerpt text: tags with a hyphen in their name go, with what they enclose where the end tag follows; other tags stay;
    white space collapses."""
    name = r"[^\s>/]*-[^\s>]*"
    return one_spaced(F.regexp_replace(text, rf"(?s)<\s*({name})(?:\s[^>]*)?>(?:.*?</\1>)?|<\s*/\s*{name}(?:\s[^>]*)?>", " "))


def without_escapes(text: Column) -> Column:
    """Terminal control sequences (CSI, OSC, DCS, PM, APC) and other control characters removed, but tab and line ends."""
    text = F.regexp_replace(text, r"\x1b\[[0-?]*[ -/]*[@-~]", "")
    text = F.regexp_replace(text, r"(?s)\x1b[\]PX^_].*?(?:\x07|\x1b\\)", "")
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def without_tags(text: Column) -> Column:
    """Markup tags, scripts and styles out, white space collapsed."""
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " ")
    return one_spaced(F.regexp_replace(text, r"(?s)<[^>]*>", " "))


def head_tail(text: Column, most: int) -> Column:
    """A text cut to its first three quarters and last quarter of ``most`` characters, joined by a space."""
    head = most * 3 // 4
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" "), F.right(text, F.lit(most - head))))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)
