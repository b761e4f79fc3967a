"""Reads within a budget against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import reading


def record(m):
    return f"message m{m[0]} role={m[1]} line={m[2]} anchor={m[3]}\n" + "".join(f"| {x}\n" if x else "|\n" for x in m[4].split("\n"))


def plain_selection(own, focus, line, budget):
    """Indexes of the messages taken."""
    size = [len(record(m)) for m in own]
    head = lambda cut: len(f"protocol agent-read cut={cut} budget-chars={budget}\n")
    if head("none") + line + sum(size) <= budget:
        return list(range(len(own)))
    chosen = [k for k, m in enumerate(own) if focus and focus[0] <= m[0] <= focus[1]] or [0]
    used = head("head+focus+tail") + line + sum(size[k] for k in chosen)
    moved = True
    while moved:
        moved = False
        for k in (chosen[0] - 1, chosen[-1] + 1):
            if 0 <= k < len(own) and used + size[k] <= budget:
                chosen, used, moved = sorted([*chosen, k]), used + size[k], True
    return chosen


def plain_page(own, focus, ref, line, budget):
    """The text, by trying what the rules say step by step."""
    total, chosen = len(own), plain_selection(own, focus, len(line), budget)
    guarded = [k for k, m in enumerate(own) if focus and focus[0] <= m[0] <= focus[1]]
    body = {k: m[4] for k, m in enumerate(own)}

    def runs(ks, step):
        out = []
        for k in ks:
            if out and step(out[-1][-1], k):
                out[-1].append(k)
            else:
                out.append([k])
        return out

    def name(a, b):
        return f"m{a}" if a == b else f"m{a}..m{b}"

    def marker(c):
        if len(c) == total:
            return "none"
        if not c:
            return "tail"
        return "+".join([*(["head"] if c[0] > 0 else []), *(["focus"] if c[0] > 0 and c[-1] + 1 < total else []), *(["tail"] if c[-1] + 1 < total else [])])

    def text(c, cut):
        gone = [k for k in range(total) if k not in c]
        omit = ",".join(name(own[r[0]][0], own[r[-1]][0]) for r in runs(gone, lambda a, b: b == a + 1)) or "none"
        out = f"protocol agent-read cut={cut} chars={budget} policy=text omit={omit}\n" + (line if c else "")
        out += "".join(record((*own[k][:4], body[k])) for k in c)
        refs = ";".join(f"{ref}:{name(own[r[0]][0], own[r[-1]][0])}" for r in runs(gone, lambda a, b: own[b][0] == own[a][0] + 1))
        return out + (f"continue read refs={reading.escaped(refs)}\n" if gone else "")

    def trim(c, cut):
        old = {k: body[k] for k in c}
        for k in c:
            body[k] = ""
        room = max(0, budget - len(text(c, cut))) // len(c) if c else 0
        for k in c:
            keeps = [old[k]] if reading.framed_length(old[k]) <= room else []
            for n in range(len(old[k]) if not keeps else -1, -1, -1):
                made = old[k][:n] + ("\n" if n and not old[k][:n].endswith("\n") else "") + f"[omitted chars={n + 1}..{len(old[k])}; use --lines or --match]"
                if reading.framed_length(made) <= room:
                    keeps = [made]
                    break
            brief = f"[omit c1..{len(old[k])}]"
            body[k] = keeps[0] if keeps else brief if reading.framed_length(brief) <= room else ""
        return text(c, cut)

    cut = marker(chosen)
    out = text(chosen, cut)
    if len(out) > budget:
        cut = "body" if len(chosen) == total else cut
        if guarded:
            chosen = [k for k in chosen if k in guarded]
            cut = marker(chosen)
        out = trim(chosen, cut)
        while len(out) > budget and chosen and chosen[-1] not in guarded:
            chosen = chosen[:-1]
            cut = marker(chosen)
            out = trim(chosen, cut)
        out = out[:budget]
    return out


@pytest.mark.parametrize("budget", [0, 60, 150, 260, 420, 900, 2500, 50_000])
def test_reads_equal_a_plain_fold(spark, budget):
    random.seed(budget)
    messages, requests, known, want, taken = [], [], [], {}, {}
    for key in range(40):
        ordinals = sorted(random.sample(range(1, 40), random.randrange(1, 14))) if key % 2 else list(range(1, random.randrange(2, 14)))
        own = [(n, random.choice(["user", "assistant"]), n + 3, f"ma_{n}", "\n".join("w" * random.choice([0, 3, 40, 90]) for _ in range(random.randrange(1, 4)))) for n in ordinals]
        at = random.choice(ordinals)
        focus = random.choice([None, (at, at), (at, at + 2), (99, 99)])
        first, last = random.choice([(None, None), (3, None), (2, 20)])
        messages += [(key, *m) for m in own]
        requests.append((key + 100, key, first, last, *(focus or (None, None))))
        known.append((key, f"ch_{key}", f"conversation uuid={key}\n"))
        asked = [m for m in own if (first or 0) <= m[0] <= (last or 99)]
        if asked:
            want[key + 100] = plain_page(asked, focus, f"ch_{key}", f"conversation uuid={key}\n", budget)
            taken |= {(key + 100, asked[k][0]): True for k in plain_selection(asked, focus, len(f"conversation uuid={key}\n"), budget)}
    m = spark.createDataFrame(messages, "key long, ordinal long, role string, line int, anchor string, body string")
    r = spark.createDataFrame(requests, "req long, key long, first long, last long, focus_first long, focus_last long")
    c = spark.createDataFrame(known, "key long, ref string, conversation string")
    rows = reading.asked_messages(m, r).join(c, "key")
    assert {(x.req, x.ordinal): True for x in reading.selected(rows, F.length("conversation"), budget).where("taken").collect()} == taken
    assert {x.req: x.text for x in reading.pages(m, c, r, budget).collect()} == want


def test_only_near_messages_are_ranked(spark):
    m = spark.range(1, 200_000).selectExpr("1L AS key", "id AS ordinal", "'user' AS role", "1 AS line", "'' AS anchor", "'b' AS body")
    r = spark.createDataFrame([(1, 1, None, None, 90_000, 90_000)], "req long, key long, first long, last long, focus_first long, focus_last long")
    got = reading.selected(reading.asked_messages(m, r), F.lit(10), 2000)
    near = [x.ordinal for x in got.where("taken").collect()]
    assert 90_000 in near and max(near) - min(near) + 1 == len(near) and got.count() < 200
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_runs_of_numbers(spark):
    rows = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 9, 10)] + [(2, 5)], "req int, ordinal long")
    assert sorted(tuple(r) for r in reading.ranges_of(rows).collect()) == [(1, 1, 3), (1, 7, 7), (1, 9, 10), (2, 5, 5)]
