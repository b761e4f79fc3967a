"""Exact deduplication by Grace hashing: partition to files, then open-addressing tables that compare whole contents.

Texts are equal when they are identical after the ASCII white space is deleted.

1. Scan: each task keeps an open-addressing table of whole contents (bounded bytes, then flushed), so copies that lie
   together collapse before anything moves. It spills classes (content, size, best row) and slim members to a table in
   the shared folder.
2. Buckets: classes are dealt by a hash of the content's digest. A bucket whose classes pass ``bucket_bytes`` is taken
   from the spill files again and dealt by the next hash, and so on until every bucket fits or holds one digest only; of
   such a bucket a table keeps one content, however many rows have it.
3. A task sorts its rows by bucket and starts a new table at each bucket; copies are compared and dropped, never gathered.
4. Members meet their class by its number; a class number never has more rows than one scan table held.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id (null
ids last). Of wholly equal rows one stays. Defined cases: null texts are empty texts, and all empty texts are equal;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WHITE, Scratch, filled, freed, shuffle_partitions

_SPILL = "uid long, doc_id long, best boolean, hash long, content binary, n_bytes long, n long, points long"
_CLASS = "uid long, keep_id long, group_size long, kept boolean, text_sha256 string, table_bytes long"
_WORST = 1 << 63


class ContentTable:
    """Open addressing with linear probing; an entry matches only if its whole content is equal."""

    def __init__(self, slots: int = 1 << 12) -> None:
        self.slots = array("q", [-1]) * slots
        self.hashes = array("q")
        self.contents: list[bytes] = []
        self.bytes = 0

    def put(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)"""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        self.slots[at] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        return e, True

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _scan(table_bytes: int, flush_rows: int = 50_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        used = 0
        table, rows, stats = ContentTable(), [], []

        def flush() -> pa.RecordBatch:
            nonlocal table, rows, stats, used
            n, m = len(table.contents), len(rows)
            best = np.zeros(m, dtype=bool)
            best[[s[2] for s in stats]] = True
            base = first + used
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array([r[0] for r in rows], dtype=np.int64) + base, np.arange(n, dtype=np.int64) + base])),
                    pa.array([r[1] for r in rows] + [s[1] for s in stats], pa.int64()),
                    pa.array(np.concatenate([best, np.zeros(n, dtype=bool)])),
                    pa.array([None] * m + list(table.hashes), pa.int64()),
                    pa.array([None] * m + table.contents, pa.binary()),
                    pa.array([None] * m + [len(c) for c in table.contents], pa.int64()),
                    pa.array([None] * m + [s[3] for s in stats], pa.int64()),
                    pa.array([None] * m + [s[0] for s in stats], pa.int64()),
                ],
                ["uid", "doc_id", "best", "hash", "content", "n_bytes", "n", "points"],
            )
            used += n
            table, rows, stats = ContentTable(), [], []
            return out

        for b in batches:
            texts = filled(b.column(1))
            for doc, text, points in zip(b.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
                content = text.translate(None, WHITE)
                e, new = table.put(int.from_bytes(hashlib.sha256(content).digest()[:8], "little", signed=True), content)
                if new:
                    stats.append([points, doc, len(rows), 1])
                else:
                    s = stats[e]
                    s[3] += 1
                    if (-points, _WORST if doc is None else doc) < (-s[0], _WORST if s[1] is None else s[1]):
                        s[:3] = points, doc, len(rows)
                rows.append((e, doc))
                if table.bytes >= table_bytes or len(rows) >= flush_rows:
                    yield flush()
        if rows:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, uid, doc_id, hash, content, n, points) sorted by bucket: each class and what it is together."""
    now, table, stats, uids, entries = None, ContentTable(), [], array("q"), array("q")

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal table, stats, uids, entries
        digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for at in range(0, len(uids), 50_000):
            part = range(at, min(at + 50_000, len(uids)))
            own = [entries[i] for i in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uids[i] for i in part], pa.int64()),
                    pa.array([stats[e][1] for e in own], pa.int64()),
                    pa.array([stats[e][2] for e in own], pa.int64()),
                    pa.array([stats[e][0][2] == uids[i] for i, e in zip(part, own, strict=True)], pa.bool_()),
                    pa.array([digests[e] for e in own], pa.string()),
                    pa.array([table.bytes] * len(part), pa.int64()),
                ],
                ["uid", "keep_id", "group_size", "kept", "text_sha256", "table_bytes"],
            )
        table, stats, uids, entries = ContentTable(), [], array("q"), array("q")

    for b in batches:
        for bucket, uid, doc, h, content, n, points in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now:
                yield from flush()
                now = bucket
            e, new = table.put(h, content)
            key = (-points, _WORST if doc is None else doc, uid)
            if new:
                stats.append([key, doc, n])
            else:
                s = stats[e]
                s[2] += n
                if key < s[0]:
                    s[:2] = key, doc
            uids.append(uid)
            entries.append(e)
    yield from flush()


def merged_classes(spill: DataFrame, bucket_bytes: int) -> DataFrame:
    """What each class of the spill table is together, with the bytes of the table that told (at most ``bucket_bytes`` and
    200 an entry, but where one content alone is larger)."""
    left, parts, level = spill.where("hash is not null"), [], 0
    while True:
        total = left.agg(F.sum("n_bytes")).first()[0] or 0
        n = max(shuffle_partitions(spill.sparkSession), -(-total // bucket_bytes))
        dealt = left.withColumn("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(n)))
        sizes = dealt.groupBy("bucket").agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        over = sizes.where((F.col("bytes") > bucket_bytes) & (F.col("low") < F.col("high"))).select("bucket")
        whole = over.isEmpty()
        fit = dealt if whole else dealt.join(over, "bucket", "left_anti")
        parts.append(fit.select("bucket", "uid", "doc_id", "hash", "content", "n", "points").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(freed(_merge), _CLASS))
        if whole:
            return reduce(DataFrame.unionByName, parts)
        left = dealt.join(over, "bucket", "left_semi").drop("bucket")
        level += 1


def exact_dedup(docs: DataFrame, bucket_bytes: int = 64_000_000, table_bytes: int = 16_000_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of (doc_id, text). The spill table stays in ``scratch`` as
    long as the result is read; a caller that stores the result may drop ``spill``."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    spill = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(_scan(table_bytes)), _SPILL), "spill")
    members = spill.where("hash is null").select("uid", "doc_id", "best")
    return members.join(merged_classes(spill, bucket_bytes).drop("table_bytes"), "uid").select("doc_id", "keep_id", "group_size", (F.col("kept") & F.col("best")).alias("kept"), "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
             first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
