import base64
import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long, refers_to string, path string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)


def plain(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data, target = (html or "").encode(), first.get(html or "")
        again = len(data) >= least and target is not None and (i is None or i > target)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=str)


def rows_for(seed):
    random.seed(seed)
    rows = [(i, f"http://a.example/{i}", "".join(random.choice("abcä<>&\n \x1f") for _ in range(random.choice([1, 50, 3000])))) for i in range(60)]
    rows += [(100 + i, "http://b.example/x y\r\nz: 1", "hot page") for i in range(200)]
    rows += [(2, None, None), (1, None, ""), (70, "u", ""), (None, "u", "hot page"), (None, "u", "alone"), (None, "u", "alone"), (5, "u", rows[5][2]), (90, "", "x" * 400_000), (91, "ü/ß?%20", os.urandom(60_000).hex())]
    return rows


def digests(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", [1 << 25, 997, 64])
@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, split, least):
    rows = rows_for(split)
    got = warc.archive_digests(frame(spark, rows), least, split_bytes=split)
    assert digests(got) == plain(rows, least)
    assert got.where("not sound").count() == 0


def test_small_files_shuffle_join_and_payloads(spark, tmp_path):
    rows = rows_for(7)
    made = warc.write_archives(frame(spark, rows), f"file://{tmp_path}/out", file_bytes=20_000, most_broadcast=0)
    files = made.collect()
    assert len(files) > 4 and sum(f.records - 1 for f in files) == len(rows)
    for f in files:  # any gzip reader takes them
        data = gzip.open(f.path.removeprefix("file://")).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    got = warc.read_archives(made, 5000, keep_payload=True).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in got) == sorted((html or "").encode() for (i, _, html), p in zip(sorted(rows, key=lambda r: str((r[0], len((r[2] or "").encode()), base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode()))), sorted(plain(rows), key=lambda p: str(p[:3]))) if p[3] == "response")
    assert not [f for f in os.listdir(f"{tmp_path}/out/archives") if ".part" in f]


def test_empty(spark):
    assert warc.archive_digests(frame(spark, [])).count() == 0


def archive(bodies, level=6):
    data, starts = b"", []
    for i, body in enumerate(bodies):
        starts.append(len(data))
        data += b"".join(warc.member(warc.record(i, None, body, None, "2024-01-01T00:00:00Z"), level))
    return data, starts


def read(data, cuts):
    edges = [0, *sorted(set(cuts)), len(data)]
    return [r for a, b in zip(edges, edges[1:]) for r in warc.records_in(warc.Source(pa.BufferReader(data)), a, b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=4000), min_size=1, max_size=8), st.lists(st.floats(0, 1), max_size=12))
def test_any_cuts_give_each_record_once(bodies, cuts):
    data, starts = archive(bodies)
    got = read(data, [int(c * len(data)) for c in cuts])
    assert [r["at"] for r in got] == starts
    assert [r["payload_bytes"] for r in got] == [len(b) for b in bodies] and all(r["sound"] for r in got)


def test_false_magic_and_damage():
    bodies = [b"a" * 500, warc.MAGIC * 300, gzip.compress(b"not a record") * 20, b"z" * 3_000_000, b"end"]
    data, starts = archive(bodies, level=0)  # stored: the false magic is in the file as it is
    assert data.count(warc.MAGIC) > 300
    assert [r["at"] for r in read(data, range(10, len(data), 977))] == starts
    broken = bytearray(data)
    broken[starts[1] + 400] ^= 0xFF  # one member's sum no longer fits
    assert [r["at"] for r in read(bytes(broken), [])] == [starts[0], *starts[2:]]
    assert [r["at"] for r in read(data[:-40], [])] == starts[:-1]


def test_header_says_another_digest():
    parts = warc.record(1, "u", b"body", None, "2024-01-01T00:00:00Z")
    parts[2] = b"bodY"
    assert [r["sound"] for r in read(b"".join(warc.member(parts, 6)), [])] == [False]


def test_query_is_its_sql(spark, tmp_path):
    import duckdb

    from palaver.llm import queries

    rows = [r for r in rows_for(3) if r[0] is not None]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert digests(queries.QUERIES["op12_warc"](spark, str(tmp_path))) == sorted(con.execute(queries.ORACLES["op12_warc"]).fetchall(), key=str) == plain(rows)
