"""Surrogates keep gender, script and check digits, stay distinct, and never run out."""

import re

import pytest

from palaver.llm.pii import pseudonymise

TEXTS = [
    "г-жа Анна Петрова и господин Иван Петров",
    "田中@例え.jp",
    "IBAN DE89370400440532013000 and GB29 NWBK 6016 1331 9268 19",
    "κυρία Μαρία Παπαδοπούλου",
    "Mr. John Smith met Dr Smith",
    None,
    "",
    "ann@one.de " + "plain words " * 20_000,
    *[f"m{i}@d{i % 37}.de 1{i % 10}.{i // 10}.{i % 7}.{i % 3}" for i in range(60)],
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    return {r.doc_id: r for r in pseudonymise(docs, "key").collect()}


def valid_iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_gender_and_script(rows):
    m = re.fullmatch(r"г-жа (\w+) (\w+) и господин (\w+) (\w+)", rows[0].text)
    assert m[2][-1] in "ая" and m[4][-1] not in "ая" and (m[1], m[3]) != ("Анна", "Иван")
    assert re.fullmatch(r"[一-鿿]{2}@[一-鿿][ぁ-ゟ]\.jp", rows[1].text) and rows[1].text != TEXTS[1]
    assert rows[3].text.endswith(("ου", "η")) and rows[3].text != TEXTS[3]
    first, second = re.fullmatch(r"Mr\. \S+ (\S+) met Dr (\S+)", rows[4].text).groups()
    assert first == second != "Smith"


def test_check_digits(rows):
    found = re.fullmatch(r"IBAN (DE\w{20}) and (GB[\w ]{25})", rows[2].text).groups()
    assert all(map(valid_iban, found)) and not any(x in TEXTS[2] for x in found)


def test_distinct_and_coherent(rows):
    domains, hosts = {}, {}
    for i, t in enumerate(TEXTS[8:], 8):
        (a, x), (b, y) = t.split(), rows[i].text.split()
        domains.setdefault(a.split("@")[1], set()).add(b.split("@")[1])
        hosts.setdefault(x, set()).add(y)
    for met in (domains, hosts):
        new = set().union(*met.values())
        assert all(len(v) == 1 for v in met.values()) and len(new) == len(met) and not new & set(met)


def test_nothing_and_long_texts(rows):
    assert (rows[5].text, rows[5].n_entities, rows[6].text) == (None, 0, "")
    assert rows[7].n_entities == 1 and rows[7].text.endswith("plain words " * 20_000) and not rows[7].text.startswith("ann@one")


def test_more_entities_than_a_format_holds(spark):
    """All addresses of four single digits would need surrogates that are none of them; they go on to other forms."""
    hosts = [f"{a}.{b}.1.{c}" for a in range(1, 10) for b in range(10) for c in range(10)]
    got = pseudonymise(spark.createDataFrame([(i, x) for i, x in enumerate(hosts)], "doc_id long, text string"), "key").collect()
    assert len({r.text for r in got}) == len(hosts) and not {r.text for r in got} & set(hosts)


PROBES = [
    "Mrs Emma Stone wrote; Dr Emma Stone and Prof. Emma Stone answered.",
    "Dr Алексей Иванов и Доктор Мария Шевченко",
    "Dr Maria called",
    "call +49 170 1234567 or +44 20 79460958 now",
    "0049 170 1234567 is the same",
    "030/1234567, (030) 1234567, 0170 1234567, 030 1234567",
    "host 2001:db8:85a3:8d3:1319:8a2e:370:7348 and fe80::1ff:fe23:4567:890a at 12:30:45",
    "Frau Müller-Lüdenscheidt und Herr Müller",
    "born 05-2024, at 0.12345678, on 01.02.2024, room 01/02",
    "Dr Илья Кузнецов, г-жа Мария Шевченко",
]


@pytest.fixture(scope="module")
def probes(spark):
    docs = spark.createDataFrame(list(enumerate(PROBES)), "doc_id long, text string")
    return [r.text for r in sorted(pseudonymise(docs, "key").collect(), key=lambda r: r.doc_id)]


def test_one_surrogate_a_name_whatever_the_title(probes):
    first, second, third = re.fullmatch(r"Mrs (\w+ \w+) wrote; Dr (\w+ \w+) and Prof\. (\w+ \w+) answered\.", probes[0]).groups()
    assert first == second == third != "Emma Stone"
    from palaver.llm.pii import ENDS, GIVEN

    given = first.split()[0]
    assert given in GIVEN["latin", "f"] or given.endswith(tuple(ENDS["latin", "f"]))


def test_given_name_and_surname_agree(probes):
    man, woman = re.fullmatch(r"Dr (\w+ \w+) и Доктор (\w+ \w+)", probes[1]).groups()
    assert man.split()[0][-1] not in "ая" and man.split()[1][-1] not in "ая"
    assert woman.split()[0][-1] in "ая" and woman.split()[1][-1] in "ая"  # of a surname that shows nothing
    man, again = re.fullmatch(r"Dr (\w+ \w+), г-жа (\w+ \w+)", probes[9]).groups()
    assert man.split()[0][-1] not in "ая" and man.split()[1][-1] not in "ая" and again == woman
    from palaver.llm.pii import ENDS, GIVEN

    alone = re.fullmatch(r"Dr (\w+) called", probes[2])[1]
    assert alone in GIVEN["latin", "f"] or alone.endswith(tuple(ENDS["latin", "f"]))


def test_no_digit_of_a_phone_is_left(probes):
    one, two = re.fullmatch(r"call (\+49 \d{3} \d{7}) or (\+44 \d\d \d{8}) now", probes[3]).groups()
    assert "1234567" not in probes[3] and "79460958" not in probes[3]
    same = re.fullmatch(r"(0049 \d{3} \d{7}) is the same", probes[4])[1]
    assert same[2:] == one[1:]
    found = re.fullmatch(r"(0\d\d/\d{7}), (\(0\d\d\) \d{7}), (0\d{3} \d{7}), (0\d\d \d{7})", probes[5]).groups()
    digits = [re.sub(r"\D", "", x) for x in found]
    assert "1234567" not in probes[5] and digits[0] == digits[1] == digits[3] != digits[2]
    assert probes[8] == PROBES[8]  # dates and fractions are no phones


def test_other_addresses_and_joined_names(probes):
    long, short = re.fullmatch(r"host ([0-9a-f:]+) and ([0-9a-f:]+) at 12:30:45", probes[6]).groups()
    assert [len(x) for x in long.split(":")] == [4, 3, 4, 3, 4, 4, 3, 4] and long != "2001:db8:85a3:8d3:1319:8a2e:370:7348"
    assert [len(x) for x in short.split(":")] == [4, 0, 3, 4, 4, 4] and short != "fe80::1ff:fe23:4567:890a"
    joined, alone = re.fullmatch(r"Frau (\w+-\w+) und Herr (\w+)", probes[7]).groups()
    assert joined.split("-")[0] == alone and all(re.search("[^\x00-\x7f]", x) and x[0].isupper() for x in joined.split("-")) and "Müller" not in joined
