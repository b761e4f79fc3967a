import random
import re
from itertools import permutations

from palaver.llm.filter_audit import audit

DOCS = "doc_id long, text string, source string, part string, digest string, bits int, n int, good int"
LABELS = "doc_id long, quality int, toxic int, part string, n int"


def plain(docs, labels):
    """The metrics by applying each order to each document."""
    fails = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        own = [x for x in labels if i is not None and x[0] == i]
        fails.append((source or "", {k for k, v in f.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {x[0] for x in fails}:
        rows = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = rows
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                redundant = sum(c in x[1] for x in rows) - len(gone)
                left = [x for x in left if c not in x[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(x[1] == {c} for x in rows), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return sorted((p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items())


def run(spark, docs, labels):
    got = audit(spark.createDataFrame([(*d, "x", "y", 1, 2, 3) for d in docs], DOCS), spark.createDataFrame([(*x, "x", 1) for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in got.collect())


def test_equal_to_every_order_on_every_document(spark):
    random.seed(4)
    long = [" ".join(random.choice("alpha beta gamma delta epsilon".split()) + str(random.randrange(k)) for _ in range(250)) for k in (1, 30, 900)]
    texts = [*long, *[t + " #" for t in long], *[t.upper() for t in long], long[2] + " A" * 50, "short", "Short & BAD", "", None, " \x0b\t", "word\x1cword \xa0 x", "same " * 300]
    docs = [(random.randrange(150), random.choice(texts), random.choice(["s0", "s1", "", None])) for _ in range(160)]
    docs += [(200 + i, "hot text", "s0") for i in range(120)]  # one text in a third of all rows
    docs += [(None, "hot text", "s1"), (None, None, None), (7, "twice", "s2"), (7, "twice", "s2"), (8, "twice", "s2"), (9, "y" * 300_000, "s2")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", "s")], []) == plain([(1, "a", "s")], [])
