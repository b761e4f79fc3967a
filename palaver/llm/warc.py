"""WARC archives: one gzip member a record, written by tasks, and a reader that splits archives at byte ranges.

Writing. Payloads are told apart by digest and length. Of equal payloads (of ``least_bytes`` or more) the page with the
smallest id is a response, the others are revisits of it without a payload. Only groups of two and more rows are joined
to the pages; they are broadcast while they are few, and a shuffle join serves beyond that. Tasks stream records to files
of about ``file_bytes``, under a name of the attempt that is changed when the file is whole.

Reading. A task gets a byte range of a file. It looks for the gzip magic, and takes a place as a member only if it inflates
to a WARC version line and a full header; from there it goes from member to member. A record belongs to the range its
member starts in, so the task reads on past the range to that member's end and no record is read twice or missed.
Payloads are inflated in steps and only their length and digest are kept, unless asked for. After a damaged member the
search for magic goes on. (A payload that itself holds whole WARC members could mislead a range that starts inside it, if
it were stored and not deflated; the writer always deflates.)

Defined cases: a null html is an empty payload, and all empty ones are equal; a null page_id is larger than all others, and
is never the target of a revisit; where no row of a group has an id all are responses; rows that repeat the smallest id are
all responses; a null url gives the target ``urn:x-page:<id>``; empty tables write no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, shuffle_partitions

# Values of the format (fixed).
MAGIC, VERSION, CRLF = b"\x1f\x8b\x08", "WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, bytes long, records long"
_RECORD = "path string, at long, record_type string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string, sound boolean, payload binary"
_STEP = 1 << 20


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def header_block(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> list[bytes]:
    """The parts of a response, or of a revisit where ``refers_to`` is given."""
    http = header_block("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = b"" if refers_to is not None else payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", record_id(page_id)[1:-1] if url is None else quote(url, safe="!#$%&'()*+,-./:;=?@[]_~"))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(hashlib.sha1(payload).digest())}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return [header_block(VERSION, fields), http, body, CRLF + CRLF]


def member(parts: list[bytes], level: int) -> Iterator[bytes]:
    """One gzip member, without a time so that a retried task writes the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for p in parts:
        for at in range(0, len(p), _STEP):
            if out := z.compress(p[at : at + _STEP]):
                yield out
    yield z.flush()


def _uri(path: str) -> str:
    """Hadoop writes local paths as file:/x; Arrow wants file:///x."""
    return re.sub("^file:/(?!/)", "file:///", path)


def with_targets(pages: DataFrame, scratch: Scratch, least_bytes: int, most_broadcast: int) -> DataFrame:
    """page_id, url, html and, for revisits, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256))))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").select("digest", "first")
    groups = scratch.write(groups, "groups")
    if groups.count() <= most_broadcast:
        groups = F.broadcast(groups)
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, out_dir: str, least_bytes: int = 0, file_bytes: int = 1 << 30, level: int = 6, date: str = "1970-01-01T00:00:00Z", most_broadcast: int = 200_000) -> DataFrame:
    """Writes ``out_dir``/archives/*.warc.gz of (page_id, url, html); returns their manifest (also written, ``out_dir``/manifest)."""
    spark, out_uri = pages.sparkSession, _uri(out_dir)
    scratch = Scratch(spark, "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(f"{out_uri}/archives")
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0

        def put(parts: list[bytes]) -> None:
            nonlocal size, count
            for x in member(parts, level):
                out.write(x)
                size += len(x)
            count += 1

        def close() -> None:
            nonlocal out
            out.close()
            store.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            made.append((f"{out_uri}/archives/{name}", size, count))
            out = None

        try:
            for b in batches:
                for page_id, url, html, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist(), strict=True):
                    if out is None:
                        name, size, count = f"part-{task.partitionId():06d}-{len(made):05d}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}")
                        info = b"software: palaver\r\nformat: WARC file version 1.1\r\n"
                        put([header_block(VERSION, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]), info, CRLF + CRLF])
                    put(record(page_id, url, html.as_py(), first, date))
                    if size >= file_bytes:
                        close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:  # what a failed attempt began
                out.close()
                store.delete_file(f"{root}/.{name}.{task.taskAttemptId()}")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    with_targets(pages, scratch, least_bytes, most_broadcast).mapInArrow(run, _MANIFEST).write.parquet(f"{out_dir}/manifest")
    scratch.drop("groups")
    return spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest")


class Source:
    """A file read in steps; what was read last is kept."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def view(self, at: int, least: int) -> memoryview:
        """Bytes from ``at``, ``least`` of them at least unless the file ends."""
        have = self.at + len(self.data)
        if at < self.at or (at + least > have and have < self.size) or at > have:
            kept = self.data[at - self.at :] if self.at <= at <= have else b""
            self.file.seek(at + len(kept))
            self.data, self.at = kept + self.file.read(max(_STEP, least)), at
        return memoryview(self.data)[at - self.at :]

    def magic_from(self, at: int, end: int) -> int | None:
        """The first place in [at, end) with the gzip magic."""
        while at < end and len(self.view(at, len(MAGIC))) >= len(MAGIC):
            hit = self.data.find(MAGIC, at - self.at)
            if hit >= 0:
                return self.at + hit if self.at + hit < end else None
            at = self.at + len(self.data) - len(MAGIC) + 1
        return None


class Member:
    """The record in the gzip member at a place, inflated step by step."""

    def __init__(self, source: Source, at: int) -> None:
        self.source, self.at, self.taken = source, at, 0
        self.z = zlib.decompressobj(31)
        self.held = b""

    def more(self) -> bytes:
        """The next inflated bytes; empty at the member's end. zlib.error or EOFError where it is damaged."""
        while not self.z.eof:
            fed = self.z.unconsumed_tail
            if not fed:
                fed = self.source.view(self.at, 1)[: 1 << 14]
                if not len(fed):
                    raise EOFError("the member is cut off")
                self.at += len(fed)
            out = self.z.decompress(fed, _STEP)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
            if out:
                return out
        return b""

    def block(self, first: bytes, most: int = 1 << 20) -> dict[str, str] | None:
        """Reads a header block that begins with ``first``; None if it is not one."""
        while CRLF + CRLF not in self.held:
            if self.held[: len(first)] != first[: len(self.held)] or len(self.held) > most or not (x := self.more()):
                return None
            self.held += x
        head, _, self.held = self.held.partition(CRLF + CRLF)
        self.taken += len(head) + 4
        if not head.startswith(first):
            return None
        lines = head.decode("utf-8", "replace").split("\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> Iterator[bytes]:
        """The next n inflated bytes."""
        while n:
            self.held = self.held or self.more()
            if not self.held:
                raise EOFError("the record is cut off")
            x, self.held = self.held[:n], self.held[n:]
            n -= len(x)
            self.taken += len(x)
            yield x


def header_at(source: Source, at: int) -> tuple[Member, dict[str, str]] | None:
    """The member at a place and its WARC header, if it is one."""
    m = Member(source, at)
    try:
        head = m.block(b"WARC/1.")
    except (zlib.error, EOFError):
        return None
    ok = head and head.get("content-length", "").isdigit() and "warc-type" in head and "warc-record-id" in head
    return (m, head) if ok else None


def read_record(m: Member, head: dict[str, str], keep: bool) -> dict:
    """The rest of a record: its payload's length and digest (of what is there; for revisits as its headers say), and
    whether all of it is sound."""
    left, kind = int(head["content-length"]), head["warc-type"]
    sha, n, kept, http = hashlib.sha1(), 0, [], None
    if "application/http" in head.get("content-type", ""):
        before = m.taken
        http = m.block(b"HTTP/")
        if http is None:
            raise zlib.error("no HTTP header")
        left -= m.taken - before
    for x in m.take(left):
        sha.update(x)
        n += len(x)
        if keep:
            kept.append(x)
    tail = b"".join(m.take(4))
    ended = not m.held and not m.more()
    said, found = head.get("warc-payload-digest", "").removeprefix("sha1:"), base32_sha1(sha.digest())
    if kind == "revisit":
        length = (http or {}).get("content-length", "")
        return {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": said, "sound": ended and tail == CRLF + CRLF, "payload": None}
    return {"payload_bytes": n, "payload_digest": found, "sound": ended and tail == CRLF + CRLF and said in ("", found), "payload": b"".join(kept) if keep else None}


def records_in(source: Source, start: int, end: int, keep: bool = False) -> Iterator[dict]:
    """The records whose members start in [start, end)."""
    at: int | None = start
    sure = start == 0
    while at is not None and at < end:
        found = header_at(source, at) if sure else None
        if not found:  # a range starts anywhere; so does what follows a damaged member
            at = source.magic_from(at, end)
            if at is None:
                return
            found = header_at(source, at)
        if not found:
            at, sure = at + 1, False
            continue
        m, head = found
        try:
            body = read_record(m, head, keep)
        except (zlib.error, EOFError):
            at, sure = at + 1, False
            continue
        yield {"at": at, "record_type": head["warc-type"], "record_id": head["warc-record-id"], "target": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), **body}
        at, sure = m.at, True


def read_archives(archives: DataFrame, split_bytes: int = 1 << 25, keep_payload: bool = False) -> DataFrame:
    """Every record of the files (path, bytes), each read by byte ranges of ``split_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_()), ("payload", pa.binary())])
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = fs.FileSystem.from_uri(_uri(path))
                with store.open_input_file(name) as f:
                    rows, size = [], 0
                    for r in records_in(Source(f), start, end, keep_payload):
                        rows.append({"path": path, **r})
                        size += len(r["payload"] or b"") + 500
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long")))
    ranges = archives.where("bytes > 0").withColumn("start", starts).select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    n = max(1, min(ranges.count(), 4 * shuffle_partitions(archives.sparkSession)))
    return ranges.repartition(n).mapInArrow(run, _RECORD)


def _page(uri: str) -> Column:
    return F.regexp_extract(uri, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def archive_digests(pages: DataFrame, least_bytes: int = 0, out_dir: str | None = None, split_bytes: int = 1 << 25) -> DataFrame:
    """Writes the archives (below the shared folder unless told where) and returns what reading them back gives for each page."""
    out_dir = out_dir or Scratch(pages.sparkSession, "warc").root
    rows = read_archives(write_archives(pages, out_dir, least_bytes), split_bytes).where("record_type in ('response', 'revisit')")
    return rows.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"), "target", "sound")


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM g
"""
