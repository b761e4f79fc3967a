"""Surrogates for personal data, in DataFrame operations only.

Detected: e-mail addresses, phone numbers, card and account numbers, social security numbers, IBANs, IPv4 and IPv6 addresses,
keys in hex, and names after a form of address. Each entity gets a keyed replacement of its own type: digits for digits,
letters for letters of the same script and case, separators, length, top-level domain and country kept (also a phone's
country code and leading zero), valid check digits of cards and IBANs kept valid, names of the same gender and script,
joined names part by part, accented ones with an accent.

Gender belongs to a name, not to a mention: what most gendered titles of the corpus say for it, or, without them, a table of
given names and the ends of Cyrillic and Greek names. So a name has one replacement whatever title it stands with. A Cyrillic
or Greek surname shows its gender by its end, and so does its replacement.

Coreference: a replacement depends on the entity's canonical form (digits of a number, 00 of a phone as +, folded address,
name part) and the key, so an entity reads the same in every document and every format it is written in; addresses of one
domain share one new domain, and no two domains do. Distinctness: replacements are drawn by keyed hashes, then checked over the whole corpus;
where two entities drew the same one, or one that is another's original, all but the first draw again until none is left.
From the fourth draw on an address may take octets of other lengths; after the twelfth, what has still collided gets one
character more with each draw, so that the draws end however many entities share a format.

Only distinct entities are drawn and checked. Documents meet their replacements by a hash of the text, and documents
without a digit, an at sign or a form of address take no part in that shuffle.

Defined cases: a null text stays null, an empty one empty, each with 0 entities; repeated rows each give their row;
an empty table gives an empty result; other columns are not read. The key is a parameter and no secret of this file.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch

# Forms of address by gender; a name follows them.
MALE_TITLES = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа", "г-жа", "κυρία"]
OTHER_TITLES = ["Dr", "Prof", "Doctor", "Professor", "Доктор", "Docteur", "Doctora"]
_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True)) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’-]+"

# Given names that replace given names, by script and gender.
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Caspar", "Damian", "Edgar", "Fabian", "Gideon", "Hugo", "Ivan", "Julian", "Kilian", "Lorenz", "Marius", "Nestor", "Oscar", "Quentin", "Roland", "Silas", "Tobias", "Victor"],
    ("latin", "f"): ["Adela", "Beatrix", "Clara", "Daphne", "Elena", "Flora", "Greta", "Helena", "Iris", "Judith", "Klara", "Livia", "Marina", "Nora", "Olivia", "Paula", "Rosa", "Sylvia", "Thea", "Viola"],
    ("cyrillic", "m"): ["Аркадий", "Борис", "Виктор", "Глеб", "Денис", "Захар", "Кирилл", "Леонид", "Матвей", "Никита", "Роман", "Тимур"],
    ("cyrillic", "f"): ["Алина", "Вера", "Галина", "Дарья", "Зоя", "Инна", "Ксения", "Лидия", "Марта", "Нина", "Раиса", "Тамара"],
    ("greek", "m"): ["Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Κώστας", "Λεωνίδας", "Νίκος", "Σταύρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
}
GIVEN |= {(s, "u"): [x for pair in zip(GIVEN[s, "m"], GIVEN[s, "f"], strict=True) for x in pair] for s in ("latin", "cyrillic", "greek")}

# Given names by which a name without a gendered title is told (besides those above), and men's names that end as women's.
KNOWN = {
    "m": "alexander andreas anton antonio carlos charles christian daniel david dmitri edward felix frank george hans henri henry jack jacques james jean jens johann john jonas jorge jose josé juan jürgen karl klaus lars lorenzo louis luis manuel marco mark martin max michael michel miguel otto pablo patrick paul pedro peter philipp pierre ralf robert stefan thomas uwe william wolfgang".split(),
    "f": "alice amélie ana andrea anna anne antonia barbara brigitte carla carmen carolina catherine charlotte chloé christine claire diana eliza elizabeth emily emma eva franziska françoise gisela hannah heike ines ingrid isabel jane jeanne jennifer johanna julia karin katharina laura lea lena linda lisa louise lucia lucy luisa margaret maria marie martha mary mia monika nathalie petra sabine sara sarah sofia sophie susan susanne ursula".split(),
}
ENDS_AS_WOMEN = "илья никита фома лука кузьма савва данила".split()

# Syllables of new surnames, and of given names once the list has collided.
ONSETS = {"latin": ["Bar", "Cal", "Dor", "Fen", "Gar", "Hal", "Kes", "Lin", "Mar", "Nor", "Pel", "Ros", "Sal", "Tor", "Var", "Wen"], "cyrillic": ["Бар", "Вол", "Гор", "Дан", "Зар", "Кал", "Лен", "Мир", "Нор", "Рад", "Сав", "Тар"], "greek": ["Αλε", "Βασ", "Γαλ", "Δρα", "Καλ", "Λαμ", "Μαρ", "Παπ", "Σαρ", "Τσα"]}
ACCENTED = ["Bär", "Cör", "Dür", "Fén", "Gör", "Häl", "Kés", "Lün", "Mär", "Nör", "Pél", "Rós", "Säl", "Tür", "Vär", "Wén"]
MIDDLES = {"latin": ["a", "e", "i", "o", "en", "in", "or", "el", "an", "er"], "cyrillic": ["а", "е", "и", "о", "ен", "ин", "ор", "ел"], "greek": ["α", "ο", "ι", "αν", "ορ", "ιν"]}
ENDS = {("latin", "sm"): ["berg", "dale", "feld", "ford", "ham", "ley", "low", "man", "mont", "ner", "sen", "ton", "vik", "well"], ("cyrillic", "sm"): ["ов", "ев", "ин", "ский"], ("cyrillic", "sf"): ["ова", "ева", "ина", "ская"], ("greek", "sm"): ["ίδης", "άκης", "όπουλος", "άτος"], ("greek", "sf"): ["ίδου", "άκη", "οπούλου", "άτου"], ("latin", "m"): ["o", "an", "us", "is"], ("latin", "f"): ["a", "ia", "ina", "elle"], ("cyrillic", "m"): ["ан", "ий", "ор"], ("cyrillic", "f"): ["а", "ия", "ина"], ("greek", "m"): ["ος", "ης", "ας"], ("greek", "f"): ["α", "η", "ία"]}

# Types in the order in which a match is told apart.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])(?!0)\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d\p{L}+])(?:"
    r"(?=(?:\+|00)(?:[ ./()-]{0,2}\d){8,15}(?![ ./-]?\d))(?:\+|00(?=[1-9]))\d{1,3}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,14})){1,7}"
    r"|(?=\(?0\d(?:[ ./()-]{0,2}\d){5,12}(?![ ./-]?\d))(?:\(0\d{1,5}\)[ ./-]?\d{2,10}|0\d{1,5}[ ./-]\d{3,10})(?:[ .-]\d{2,10}){0,4}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{2,10}(?:[ .-]\d{2,4}){1,3}|\(\d{2,4}\)[ .-]?\d{6,10}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{8,15})(?![\d\p{L}])",
    "person": rf"(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_GATE = rf"[0-9@]|(?<!\p{{L}}){_TITLE} \p{{Lu}}"
_DIGITS = ("ssn", "card", "phone")
# Country codes of one and two digits; all others have three (fixed values).
_SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_CODE = "^[+](?:" + "|".join(sorted(_SHORT_CODES, key=len)) + r"|\d{3})"


def _either(cases: list[tuple[Column, Column]], rest: Column) -> Column:
    for when, then in reversed(cases):
        rest = F.when(when, then).otherwise(rest)
    return rest


def _draw(options: list[str], *seed: Column) -> Column:
    return F.array(*map(F.lit, options))[F.pmod(F.xxhash64(*seed), F.lit(len(options))).cast("int")]


def _script(name: Column) -> Column:
    return _either([(name.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")), (name.rlike(r"\p{IsGreek}"), F.lit("greek"))], F.lit("latin"))


def _shown_gender(name: Column, script: Column) -> Column:
    """What a given name or surname says by its form: m, f or null."""
    low = F.lower(name)
    return _either(
        [
            (low.isin(ENDS_AS_WOMEN), F.lit("m")),
            ((script == "cyrillic") & low.rlike("(?:[ое]в|ёв|[иы]н|[сц]кий|[ыи]й|ой)$"), F.lit("m")),
            ((script == "cyrillic") & low.rlike("[ая]$"), F.lit("f")),
            ((script == "cyrillic") & low.rlike("[бвгджзйклмнпрстфхцчшщ]$"), F.lit("m")),
            ((script == "greek") & low.rlike("[ςσ]$"), F.lit("m")),
            ((script == "greek") & low.rlike("[αάηήου]$"), F.lit("f")),
            (low.isin(KNOWN["m"] + [x.lower() for x in GIVEN["latin", "m"]]), F.lit("m")),
            (low.isin(KNOWN["f"] + [x.lower() for x in GIVEN["latin", "f"]]), F.lit("f")),
        ],
        F.lit(None).cast("string"),
    )


def parts_of(matches: DataFrame) -> DataFrame:
    """(h, m, at, kind, part, canonical, vote) of matches (h, m): a name gives its parts between spaces and hyphens, all else
    itself. ``vote`` is the gender that the mention's title says for a name, else what its other names show."""
    m = F.col("m")
    kind = _either([(m.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("phone"))
    title = F.regexp_replace(F.regexp_extract("m", rf"^({_TITLE}) ", 1), r"\.$", "")
    titled = _either([(title.isin(MALE_TITLES), F.lit("m")), (title.isin(FEMALE_TITLES), F.lit("f"))], F.lit(None).cast("string"))
    name = F.regexp_replace("m", rf"^{_TITLE} ", "")
    last, words = F.substring_index(name, " ", -1), F.regexp_extract_all(name, F.lit("[^ -]+"), 0)
    rows = matches.withColumn("kind", kind).withColumn("words", F.when(F.col("kind") == "person", words).when(F.col("kind") == "email", F.split("m", "@")).otherwise(F.array(m)))
    others = F.filter(F.transform("words", lambda w: _shown_gender(w, _script(w))), lambda g: g.isNotNull())
    alone = ~name.contains(" ") & _shown_gender(name, F.lit("latin")).isNotNull()  # a given name after a title
    first_of_last = F.size("words") - F.when(alone, 0).otherwise(F.size(F.split(last, "-")))
    rows = rows.withColumns({"vote": F.when(F.col("kind") == "person", F.coalesce(titled, F.get(others, F.lit(0)))), "surname": first_of_last})
    rows = rows.select("h", "m", "kind", "vote", "surname", F.posexplode("words").alias("at", "part"))
    part = F.col("part")
    named = F.concat(F.when(F.col("at") >= F.col("surname"), F.lit("surname-")).otherwise(F.lit("given-")), _script(part))
    rows = rows.withColumn("kind", F.when(F.col("kind") == "person", named).when((F.col("kind") == "email") & (F.col("at") == 1), "domain").otherwise(F.col("kind")))
    digits = F.regexp_replace("part", r"\D", "")
    phone = F.when(part.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(F.regexp_replace(digits, "^00", "+"))
    canonical = F.when(F.col("kind") == "phone", phone).when(F.col("kind").isin(*_DIGITS), digits).when(F.col("kind") == "iban", F.regexp_replace("part", " ", "")).otherwise(F.lower("part"))
    return rows.select("h", "m", "at", "kind", "part", canonical.alias("canonical"), "vote")


def entities_of(parts: DataFrame) -> DataFrame:
    """Distinct (kind, canonical) with the gender of names: as most titles say, else as the name shows, else none."""
    votes = parts.groupBy("kind", "canonical").agg(F.count_if(F.col("vote") == "m").alias("m"), F.count_if(F.col("vote") == "f").alias("f"))
    script = F.substring_index("kind", "-", -1)
    own = _shown_gender(F.col("canonical"), script)
    surname = F.col("kind").startswith("surname") & own.isNotNull() & (script != "latin")
    gender = F.when(surname, own).when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise(F.coalesce(own, F.lit("u")))
    return votes.select("kind", "canonical", F.when(F.col("kind").rlike("^(?:given|surname)"), gender).otherwise("u").alias("gender"))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, mod 10."""
    n = F.length(digits)
    doubled = F.transform(_chars(digits), lambda c, i: F.when(((n - i) % 2) == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder: country and check digits behind, letters as two digits; 1 where it is valid."""
    turned = _chars(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)))
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _letter_from(draw: Column, first: int, count: int) -> Column:
    """A letter of the block that begins at code point ``first``."""
    return F.decode(F.unhex(F.lpad(F.hex(F.lit(first) + F.pmod(draw, F.lit(count))), 4, "0")), "UTF-16BE")


#: Other scripts: how a letter is known, and a run of letters of that script (first code point, how many).
BLOCKS = {"IsHan": (0x4E00, 4000), "IsHiragana": (0x3042, 80), "IsKatakana": (0x30A2, 80), "IsHangul": (0xAC00, 11000), "IsArabic": (0x0628, 18), "IsHebrew": (0x05D0, 26), "IsDevanagari": (0x0915, 36), "IsThai": (0x0E01, 40), "IsArmenian": (0x0561, 37), "IsGeorgian": (0x10D0, 32)}


def surrogate(key: str) -> Column:
    """The draw of (kind, canonical, attempt), in the shape of canonical."""
    kind, text = F.col("kind"), F.col("canonical")
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, text, F.col("attempt").cast("string")), 256)
    n = F.length(text)
    # positions that stay: the top-level domain, the country of an IBAN
    end = F.when(kind == "domain", n - F.length(F.substring_index(text, ".", -1)) - 1).otherwise(n)
    begin = F.when(kind == "iban", 2).when((kind == "phone") & text.startswith("+"), F.length(F.regexp_extract(text, _CODE, 0))).when((kind == "phone") & text.startswith("0"), 1).otherwise(0)

    def letter(c: Column, i: Column) -> Column:
        draw = F.xxhash64(seed, i.cast("int"))

        def pick(first: int, count: int) -> Column:
            return F.char(F.lit(first) + F.pmod(draw, F.lit(count)))

        digit = F.when((i == 0) & (c != "0"), F.pmod(draw, F.lit(9)) + 1).otherwise(F.pmod(draw, F.lit(10))).cast("string")
        hexed = F.substring(F.lit("0123456789abcdef"), (F.pmod(draw, F.lit(16)) + 1).cast("int"), 1)
        cyrillic = F.substring(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), (F.pmod(draw, F.lit(28)) + 1).cast("int"), 1)
        greek = F.substring(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), (F.pmod(draw, F.lit(24)) + 1).cast("int"), 1)
        return _either(
            [
                ((i < begin) | (i >= end), c),
                (kind.isin("secret", "ipv6") & c.rlike("[0-9a-fA-F]"), hexed),
                (c.rlike("[0-9]"), digit),
                (c.rlike("[A-Z]"), pick(65, 26)),
                (c.rlike("[a-z]"), pick(97, 26)),
                (c.rlike(r"\p{IsCyrillic}"), cyrillic),
                (c.rlike(r"\p{IsGreek}"), greek),
                *[(c.rlike(rf"\p{{{block}}}"), _letter_from(draw, first, count)) for block, (first, count) in BLOCKS.items()],
                (c.rlike(r"\p{L}"), pick(97, 26)),
            ],
            c,
        )

    shaped = F.array_join(F.transform(_chars(text), letter), "")
    octet = F.transform(F.split(text, r"\."), lambda o, i: F.when(F.col("attempt") >= 4, F.pmod(F.xxhash64(seed, i), F.lit(256))).when(F.length(o) == 3, 100 + F.pmod(F.xxhash64(seed, i), F.lit(100))).when(F.length(o) == 2, 10 + F.pmod(F.xxhash64(seed, i), F.lit(90))).otherwise(F.pmod(F.xxhash64(seed, i), F.lit(10))).cast("string"))
    body = F.concat(shaped.substr(F.lit(1), n - 1), F.lit("0"))
    card = F.when(_luhn(text) == 0, F.concat(body.substr(F.lit(1), n - 1), ((10 - _luhn(body)) % 10).cast("string"))).otherwise(shaped)

    open_iban = F.concat(F.substring(text, 1, 2), F.lit("00"), F.substring(shaped, 5, 64))
    iban = F.when(_mod97(text) == 1, F.concat(F.substring(text, 1, 2), F.lpad((98 - _mod97(open_iban)).cast("string"), 2, "0"), F.substring(shaped, 5, 64))).otherwise(shaped)

    def syllables(script: str, last: str) -> Column:
        onset = _draw(ONSETS[script], seed, F.lit(1))
        onset = F.when(text.rlike(r"[^\x00-\x7F]"), _draw(ACCENTED, seed, F.lit(1))).otherwise(onset) if script == "latin" else onset
        base = F.concat(onset, _draw(MIDDLES[script], seed, F.lit(2)), _draw(ENDS[script, last], seed, F.lit(3)))
        more = F.concat(_draw(ONSETS[script], seed, F.lit(4)), _draw(MIDDLES[script], seed, F.lit(5)), _draw(MIDDLES[script], seed, F.lit(7)), _draw(ENDS[script, last], seed, F.lit(6)))
        return F.when(F.col("attempt") < 3, base).otherwise(F.concat(base, F.lower(more)))

    names, gender = [], F.col("gender")
    for script in ("latin", "cyrillic", "greek"):
        women = F.lit(False) if script == "latin" else gender == "f"
        names.append((kind == f"surname-{script}", F.when(women, syllables(script, "sf" if script != "latin" else "sm")).otherwise(syllables(script, "sm"))))
        for g in ("m", "f", "u"):
            listed = (F.col("attempt") == 0) & ~text.rlike(r"[^\x00-\x7F]") if script == "latin" else F.col("attempt") == 0
            names.append(((kind == f"given-{script}") & (gender == g), F.when(listed, _draw(GIVEN[script, g], seed, F.lit(0))).otherwise(syllables(script, "m" if g == "m" else "f"))))
    named = F.lower(_either(names, F.lit(None).cast("string")))
    drawn = _either([(kind.startswith("surname") | kind.startswith("given"), named), (kind == "ip", F.array_join(octet, ".")), (kind == "card", card), (kind == "iban", iban)], shaped)
    # the last way out: characters more, in front of a domain and behind all else
    more = F.substring(F.when(kind.isin(*_DIGITS, "ip", "iban"), F.conv(F.substring(seed, 1, 12), 16, 10)).otherwise(F.translate(seed, "0123456789", "ghijklmnop")), 1, F.greatest(F.lit(0), F.col("attempt") - 12))
    return F.when(F.col("attempt") <= 12, drawn).when(kind == "domain", F.concat(more, drawn)).otherwise(F.concat(drawn, more))


def draw_all(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canonical, surrogate) of distinct (kind, canonical, gender): no surrogate twice, none an entity of its kind. What
    is settled stays; each round draws and writes only what has collided."""
    known = scratch.write(entities, "entities")
    taken = known.select("kind", F.col("canonical").alias("surrogate"))
    now, settled = known.withColumn("attempt", F.lit(0)), []
    for k in count():
        drawn = scratch.write(now.withColumn("surrogate", surrogate(key)), f"draw{k}")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        used = taken.unionByName(reduce(DataFrame.unionByName, settled).select("kind", "surrogate")) if settled else taken
        judged = drawn.join(first, ["kind", "surrogate"]).join(used.distinct().withColumn("used", F.lit(True)), ["kind", "surrogate"], "left")
        judged = judged.withColumn("bad", F.coalesce("used", F.lit(False)) | (F.col("canonical") != F.col("first")))
        judged = scratch.write(judged.select("kind", "canonical", "gender", "attempt", "surrogate", "bad"), f"judged{k}")
        settled.append(judged.where("not bad").select("kind", "canonical", "surrogate"))
        scratch.drop(f"draw{k}")
        now = judged.where("bad").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def _rendered() -> Column:
    """The surrogate in the format of the part: separators and capitals as they were."""
    part = F.col("part")
    new = F.when(F.col("kind") == "phone", F.regexp_replace("surrogate", "^[+]", F.when(part.startswith("00"), "00").otherwise(""))).otherwise(F.col("surrogate"))
    chars = _chars(part)
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.when(c.rlike("[A-Z]"), F.upper(F.substr(new, a["k"], F.lit(1)))).otherwise(F.substr(new, a["k"], F.lit(1)))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )
    step = F.concat(step["out"], F.substr(new, step["k"]))  # what is longer than the part goes behind it
    cased = F.array_join(F.transform(chars, lambda c, i: F.when((c != F.lower(c)), F.upper(F.substr(new, i + 1, F.lit(1)))).otherwise(F.substr(new, i + 1, F.lit(1)))), "")
    cased = F.concat(cased, F.substr(new, F.length(part) + 1))
    name = F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1000)))
    kind = F.col("kind")
    return F.when(kind.isin(*_DIGITS, "iban"), step).when(kind.startswith("given") | kind.startswith("surname"), name).otherwise(cased)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced) of each row of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "pii")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gate = F.coalesce(F.col("text").rlike(_GATE), F.lit(False))
    some = base.where(gate).withColumn("h", F.xxhash64("text"))
    found = some.select("h", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), 0))).alias("m")).distinct()
    parts = scratch.write(parts_of(found), "parts")
    drawn = draw_all(entities_of(parts), key, scratch)
    placed = parts.join(drawn, ["kind", "canonical"]).withColumn("new", _rendered())
    parts_new = F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"])
    address = F.bool_or(F.col("kind").isin("email", "domain"))
    # between the parts of a name stands what stood there
    between = F.split(F.regexp_replace("m", rf"^{_TITLE} ", ""), "[^ -]+", -1)
    whole = placed.groupBy("h", "m").agg(parts_new.alias("news"), address.alias("address"))
    joined = F.array_join(F.transform("news", lambda x, i: F.concat(x, F.coalesce(F.get(between, i + 1), F.lit("")))), "")
    whole = whole.select("h", "m", F.when(F.col("address"), F.array_join("news", "@")).when(F.size("news") > 1, joined).otherwise(F.get("news", F.lit(0))).alias("new"))
    title = F.regexp_extract("m", rf"^({_TITLE} )", 1)
    whole = whole.withColumn("new", F.concat(F.when(F.col("m").rlike(rf"^{_TITLE} {_NAME}"), title).otherwise(F.lit("")), F.col("new")))
    maps = whole.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("map"))
    hits, gaps = F.regexp_extract_all("text", F.lit(PATTERN), 0), F.split("text", PATTERN, -1)
    met = some.join(maps, "h", "left").select("doc_id", "text", "map", hits.alias("hits"), gaps.alias("gaps"))
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("map"), F.get(F.col("hits"), i)), F.get(F.col("hits"), i), F.lit("")))), "")
    changed = met.select("doc_id", F.when(F.size("hits") > 0, text).otherwise(F.col("text")).alias("text"), F.size("hits").cast("long").alias("n_entities"))
    return changed.unionByName(base.where(~gate).withColumn("n_entities", F.lit(0).cast("long")))
