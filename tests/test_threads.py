"""Heads, chains and forks of rollout threads against a plain walk; lines by splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palaver.plans.stored import shared_folder
from palaver.sources import rollouts, sessions

FILES = "path string, thread_id string, rollout_id string, archived boolean, size long, base struct<rollout_id:string,end:long>"


def frame(spark, files):
    return spark.createDataFrame(files, FILES)


def plain_heads(files, rows):
    name = lambda p: p.rpartition("/")[2].removesuffix(".zst")
    seen, kept = set(), []
    for f in sorted(files, key=lambda f: (f[3], f[2], f[0])):
        if name(f[0]) not in seen:
            seen.add(name(f[0]))
            kept.append(f)
    out = {}
    for t in {f[1] for f in kept}:
        own = [f for f in kept if f[1] == t and f[4] is not None]
        if not own:
            continue
        row, top = rows.get(t), lambda fs: max(fs, key=lambda f: (f[2], f[3], f[0]))
        hit = [f for f in own if row and name(f[0]) == name(row[0])]
        on = {f[5][0] for f in own if f[5]}
        if hit:
            out[t] = hit[0], "current"
        elif row and row[1]:
            out[t] = top(own), "orphaned"
        else:
            out[t] = (top([f for f in own if f[2] not in on] or own) if len(own) > 1 else own[0]), "inferred"
    return kept, out


def plain_chain(kept, t, head):
    by = {}
    for f in kept:
        by.setdefault(f[2], f)
    links, seen, now, missing = [(head[2], head[0], None, False)], {head[0]}, head, None
    while len(links) < 16 and now[5]:
        nxt = by.get(now[5][0])
        if not nxt or nxt[4] is None:
            missing = now[5][0]
            break
        if nxt[0] in seen:
            break
        links.append((nxt[2], nxt[0], now[5][1], nxt[1] != t))
        seen.add(nxt[0])
        now = nxt
    links = links[::-1]
    return [(t, k, *x, missing if k == len(links) - 1 else None) for k, x in enumerate(links)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_plain_walk(spark, seed):
    shared_folder(spark)
    random.seed(seed)
    files = []
    for k in range(120):
        base = random.choice([None, (f"r{random.randrange(130):03d}", random.randrange(99)), (f"r{max(0, k - 1):03d}", k)])
        files.append((f"/live/f{k}.jsonl", f"t{random.randrange(25)}", f"r{k if k % 11 else max(0, k - 1):03d}", random.random() < 0.3, None if random.random() < 0.1 else k, base))
    files += [(f"/live/c{k}.jsonl", "long", f"s{k:02d}", False, 1, (f"s{k - 1:02d}", 5) if k else None) for k in range(18)]  # 18 links
    files += [("/old/f3.jsonl.zst", "t1", "r003", True, 9, None), ("/live/x.jsonl", "loop", "x", False, 1, ("y", 1)), ("/live/y.jsonl", "loop", "y", False, 1, ("x", 2)), ("/live/z.jsonl", "gone", "z", False, None, None)]
    rows = {"t1": ("/else/f3.jsonl.zst", False), "t2": ("/none.jsonl", True), "t3": ("/none.jsonl", False), "loop": ("/live/x.jsonl", True), "nobody": ("/q", True)}
    kept, want = plain_heads(files, rows)
    heads = rollouts.heads(frame(spark, files), spark.createDataFrame([(t, *r) for t, r in rows.items()], "thread_id string, rollout_path string, paginated boolean")).cache()
    assert {r.thread_id: (r.rollout_id, r.path, r.archived, r.status) for r in heads.collect()} == {t: (f[2], f[0], f[3], s) for t, (f, s) in want.items()}
    got = [tuple(r) for r in rollouts.chains(heads, frame(spark, files)).collect()]
    assert sorted(got, key=repr) == sorted([x for t, (f, _) in want.items() for x in plain_chain(kept, t, f)], key=repr)
    assert sum(g[0] == "long" for g in got) == 16 and sum(g[0] == "loop" for g in got) == 2


def test_base_of_a_first_record(spark):
    lines = [json.dumps({"payload": {"history_base": {"thread_id": "AB-1", "end_byte_offset": 7}}}), json.dumps({"payload": {}}), "broken {", None, json.dumps({"payload": {"history_base": {"thread_id": "a"}}}), json.dumps({"payload": {"history_base": {"thread_id": "a", "end_byte_offset": 1}, "pad": "x" * rollouts.FIRST_RECORD}})]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "v string").select(rollouts.base(F.col("v"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("ab-1", 7), None, None, None, None, None]


def test_fork_notes(spark):
    rows = [  # place, line, visibility, inherited, kind, text
        (0, 1, "inherited", True, "message", "taken over"), (0, 2, "injected", True, "message", "never"), (0, 3, "dialogue", True, "title", "name"),
        (1, 1, "inherited", False, "message", "not again"), (1, 2, "dialogue", False, "other", "bookkeeping"), (1, 3, "dialogue", False, "message", "own"),
    ]
    table = spark.createDataFrame([("a", *r) for r in rows] + [("b", *rows[5])], "thread_id string, place int, line int, visibility string, inherited boolean, kind string, text string")
    got = sorted((r.thread_id, tuple(r["at"]), r.kind, r.text) for r in rollouts.entries(table).collect())
    assert got == [("a", (0, 1, 1), "message", "taken over"), ("a", (1, 2, 0), "note", "Fork: The conversation continues from here"), ("a", (1, 3, 1), "message", "own"), ("b", (1, 3, 1), "message", "own")]


def test_lines_of_a_base_end_at_its_cut(spark):
    lines = spark.createDataFrame([("p", 1, 0, "a"), ("p", 2, 10, "b"), ("q", 1, 0, "c")], "path string, line int, offset long, value string")
    chain = spark.createDataFrame([("t", 0, "p", 10, True), ("t", 1, "q", None, False)], "thread_id string, place int, path string, end long, inherited boolean")
    assert sorted(r.value for r in rollouts.thread_lines(lines, chain).collect()) == ["a", "c"]


def test_lines_by_splits(spark, tmp_path):
    random.seed(1)
    rows = {n: ["x" * random.choice([0, 3, 900, 40_000]) + random.choice(["é", "\r", " ", "", "end"]) for _ in range(400)] for n in ("a", "b")}
    for n, lines in rows.items():
        (tmp_path / f"{n}.jsonl").write_bytes("\n".join(lines).encode() + (b"\n" if n == "a" else b""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = sessions.placed_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {}
        for r in found.collect():
            got.setdefault(r.path.rpartition("/")[2][0], {})[r.line] = (r.offset, r.value)
        for n, lines in rows.items():
            lines = lines if n == "a" or lines[-1] else lines[:-1]
            at, want = 0, {}
            for k, line in enumerate(lines, 1):
                want[k] = (at, line)
                at += len(line.encode()) + 1
            assert got[n] == want
        assert sessions.lines(spark, str(tmp_path)).where("value = ''").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
