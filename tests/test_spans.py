"""Places of words and quoted texts, matches of messages and evidence, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palaver.functions.query import Literal, parse
from palaver.functions.spans import Spanned, literal_pattern, query_ranges
from palaver.functions.text import has_cjk, kind_of, normalize, normalized, starts_word
from palaver.operators import evidence, matches

TEXTS = ["Straße STRASSE strasse", "İstanbul i̇stanbul Istanbul", "a b/c-d_e", "數據 数据库 x数据", "ǅ ﬀ ffi ﬃ", "v2 2v é É", "K kelvin Å", "", "naïve NAÏVE café", "日本—the “the” …the", "𝒳the the𝒴 𝒳 the"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("word", ["strasse", "istanbul", "the", "数据", "ff", "ffi", "v", "2", "é", "k", "d", "naïve", "i"])
def test_words_land_on_whole_characters(text, word):
    spanned = Spanned(text)
    assert spanned.norm == normalize(text)
    for anywhere in (False, True):
        found = spanned.words(word, anywhere)
        norm, n, at = spanned.norm, 0, 0
        while (at := norm.find(word, at)) >= 0:
            hit = anywhere or starts_word(norm, at)
            n, at = n + hit, at + (len(word) if hit else 1)
        assert len(found) == n
        for a, b in found:
            assert word in normalize(text.encode()[a:b].decode())


def plain_literals(text, literal):
    """By trying every place."""
    out, at = [], 0
    low = lambda s: "".join(c.lower() for c in s)
    while at < len(text):
        end = None
        if starts_word(text, at):
            for stop in range(at + 1, len(text) + 1):
                got = text[at:stop] if literal.sensitive else low(text[at:stop])
                want = literal.text if literal.sensitive else low(literal.text)
                if got.startswith(want):
                    end = stop
                    break
                if not want.startswith(got):
                    break
        if end:
            out.append((len(text[:at].encode()), len(text[:end].encode())))
            at = end
        else:
            at += 1
    return out


QUOTED = ["the", "The", "i", "istanbul", "k", "ß", "ff", "数据", "a b", "a.b", "STR", "é", "...", "x"]


@pytest.mark.parametrize("quoted", QUOTED)
def test_quoted_texts(spark, quoted):
    literal = Literal.of(quoted)
    texts = [*TEXTS, "the the. THE a.b a.b.a.b ...the", "xx x.x"]
    assert [Spanned(t).literals(literal) for t in texts] == [plain_literals(t, literal) for t in texts]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k for r in rows.where(F.col("t").rlike(literal_pattern(literal))).collect()}
    skip = {k for k, t in enumerate(texts) if "İ" in t}  # its lower case is two characters, which a pattern cannot take apart
    assert got - skip == {k for k, t in enumerate(texts) if plain_literals(t, literal)} - skip


def test_column_of_ranges(spark):
    rows = spark.createDataFrame([("Straße the",), (None,), ("",)], "t string").select(query_ranges(["the", "strasse"])("t").alias("r")).collect()
    assert [None if r.r is None else [tuple(x) for x in r.r] for r in rows] == [[(0, 7), (8, 11)], None, []]


# -- matches of messages ----------------------------------------------------------------------------------------------
def plain_matches(segments, text, partial):
    q = parse(text)
    anywhere = any(map(has_cjk, q.words))
    out = {}
    for key in {s[0] for s in segments}:
        rows, strict_met = [], False
        for ordinal in sorted({s[1] for s in segments if s[0] == key}):
            own = sorted(s for s in segments if s[:2] == (key, ordinal))
            body, ranges, at = "\n".join(s[4] for s in own), [], 0
            for *_, source, t in own:
                size = len(t.encode())
                ranges += [(at, at + size, k, source) for k, w in enumerate(q.words) if Spanned(t).words(w, anywhere)]
                ranges += [(at + a, at + b, len(q.words) + k, source) for k, x in enumerate(q.literals) for a, b in Spanned(t).literals(x)]
                at += size + 1
            if not ranges:
                continue
            norm = normalize(body)
            strict = all(Spanned(body).words(w, anywhere) for w in q.words) and all(Spanned(body).literals(x) for x in q.literals)
            low, high = min(r[0] for r in ranges), max(r[1] for r in ranges)
            near = sum(f"{a} {b}" in norm for a, b in zip(q.words, q.words[1:]))
            score = 4.0 * len({r[2] for r in ranges}) + 3.0 * len(q.literals) + 2.0 * near + 1.0 / max(high - low, 1)
            data = body.encode()
            shown = data[:low].decode()[-41:] + data[low:high].decode() + data[high:].decode()[:80]
            best = min(("dialogue", "tool", "thinking").index(r[3]) for r in ranges)
            strict_met |= strict
            rows.append((strict, (key, ordinal, round(score, 9), ("dialogue", "tool", "thinking")[best], low, high, re.sub(r"\s+", " ", shown).strip()[:160], any(r[3] == "tool" for r in ranges), any(r[3] == "thinking" for r in ranges))))
        for strict, row in rows:
            if strict or (partial and not strict_met):
                out[row[:2]] = row
    return sorted(out.values())


@pytest.mark.parametrize("text", ["the fox", "fox the", "the the", 'the "a fox"', '"The"', '"fox" "den"', "数据 fox", "snake_case the", "zzz", "den é"])
@pytest.mark.parametrize("partial", [False, True])
def test_matches_equal_a_plain_version(spark, text, partial):
    random.seed(len(text))
    words = "the fox The den a fox snake_case 数据 é É x9 quick brown".split()
    rows = [(k % 7, k // 7, p, random.choice(["dialogue", "tool", "thinking"]), " ".join(random.choice(words) for _ in range(random.randrange(1, 60)))) for k in range(60) for p in range(random.randrange(1, 4))]
    table = spark.createDataFrame(rows, "key int, ordinal int, part int, source string, text string").withColumn("norm", normalized("text"))
    got = matches.match_messages(table, text, partial).collect()
    assert sorted((r.key, r.ordinal, round(r.score, 9), r.source, r["first"], r["last"], r.preview, r.tools, r.thinking) for r in got) == plain_matches(rows, text, partial)


def test_nothing_asked(spark):
    table = spark.createDataFrame([(1, 1, 0, "dialogue", "a", "a")], "key int, ordinal int, part int, source string, text string, norm string")
    assert matches.match_messages(table, "").count() == 0


# -- evidence ---------------------------------------------------------------------------------------------------------
def plain_chosen(text, preview, query):
    """The best covers, by comparing all clusters."""
    terms = evidence.terms_of(query)
    hits = sorted((a, b, k) for k, t in enumerate(terms) for a, b in t.hits(Spanned(text)))
    shown = [k for k, t in enumerate(terms) for _ in t.hits(Spanned(preview))]
    lacking = [k for k in range(len(terms)) if k not in shown]
    if not hits or (not lacking and len(hits) <= len(shown)):
        return None
    runs, data = [], text.encode()
    for a, b, k in hits:
        run = runs[-1] if runs else None
        if run and a - run["b"] <= 50 and max(run["b"], b) - run["a"] <= 200:
            gap = data[run["end"] : a].decode() if a > run["end"] else ""
            run["beside"] += k != run["k"] and gap != "" and not any(kind_of(c) != "sign" for c in gap)
            run |= {"b": max(run["b"], b), "end": b, "k": k, "all": run["all"] | {k}}
        else:
            runs.append({"a": a, "b": b, "end": b, "k": k, "all": {k}, "beside": 0})
    if lacking:
        runs = [r for r in runs if r["all"] & set(lacking)]
    runs.sort(key=lambda r: (-len(r["all"] & set(lacking)), -r["beside"], -len(r["all"]), r["b"] - r["a"], r["a"]))
    first, met = [], set()
    for r in runs:
        if r["all"] & set(lacking) - met and len(first) < 3:
            first.append(r)
            met |= r["all"] & set(lacking)
    for r in runs:
        if len(first) < 3 and r not in first:
            first.append(r)
    return sorted((r["a"], r["b"]) for r in first) or None


def test_evidence_equals_a_plain_version(spark):
    random.seed(5)
    words = ["red", "fox", "den", ".", "--", "—", "filler", "ß", "x" * 30]
    rows = []
    for _ in range(300):
        text = " ".join(random.choice(words) for _ in range(random.randrange(0, 80)))
        rows.append((text, text[: random.randrange(0, 120)]))
    for query in ("red fox den", 'red "fox den"', "red", "RED red"):
        want = [plain_chosen(t, p, query) for t, p in rows]
        table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, p string")
        told = table.withColumns({"tn": normalized("t"), "pn": normalized("p")})
        got = told.select("k", evidence.against(query, 20)("t", "p").alias("e"), evidence.hides(F.col("t"), F.col("tn"), F.col("p"), F.col("pn"), query).alias("hides")).orderBy("k").collect()
        for (text, _), w, g in zip(rows, want, got, strict=True):
            assert g.hides == (w is not None)
            assert (None if g.e.ranges is None else [tuple(x) for x in g.e.ranges]) == w
            if w:  # the excerpt's ranges hold the same text
                cut = g.e.text.encode()
                assert [cut[a:b] for a, b in g.e.shown] == [text.encode()[a:b] for a, b in w]


def test_excerpt_windows():
    text = "é" * 30 + "fox" + "ü" * 30
    got, places = evidence.excerpt(text, [(60, 63)], 5)
    assert got == "…" + "é" * 5 + "fox" + "ü" * 5 + "…" and got.encode()[slice(*places[0])] == b"fox"
    assert evidence.excerpt("a fox", [(2, 5)], 9) == ("a fox", [(2, 5)])
