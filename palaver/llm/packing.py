"""Packing by optimal length buckets and token-budget batches.

A sequence is a document with its end token; one longer than ``max_len`` goes in pieces of ``max_len`` and a rest, so
nothing is cut off and the global histogram of lengths has at most ``max_len`` rows. Dynamic programming over that
histogram (lower envelope of lines, buckets x lengths steps) chooses bucket lengths with the least padding in all.

Batches form inside a bucket: a batch takes as many sequences as its token budget holds at the bucket's length. Exact
places in a bucket come without sorting it as one: rows are dealt to slices by a hash, counted, and numbered inside their
slice; the running counts of the slices before (a row each) give the place. Every batch but a bucket's last is full.

Defined cases: a null or empty text is one sequence of the end token; repeated rows and null ids each give their own
sequence; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, shuffle_partitions


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` bucket lengths, ascending, with the least total padding; each is a length that occurs."""
    lens = sorted(x for x, c in histogram.items() if c)
    if not lens:
        return []
    rows, tokens = [0], [0]
    for x in lens:
        rows.append(rows[-1] + histogram[x])
        tokens.append(tokens[-1] + x * histogram[x])
    m = len(lens)
    # cost of lengths i..j-1 in a bucket of lens[j-1]: lens[j-1] (rows[j] - rows[i]) - (tokens[j] - tokens[i])
    best = [None] + [lens[j - 1] * rows[j] - tokens[j] for j in range(1, m + 1)]
    cuts = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        now, cut = [None] * (m + 1), [0] * (m + 1)
        lines: list[tuple[int, int, int]] = []  # slope -rows[i], intercept best[i] + tokens[i], i
        at = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                slope, up = -rows[i], best[i] + tokens[i]
                while len(lines) > 1 and (lines[-1][1] - lines[-2][1]) * (lines[-1][0] - slope) >= (up - lines[-1][1]) * (lines[-2][0] - lines[-1][0]):
                    lines.pop()
                lines.append((slope, up, i))
            at = min(at, len(lines) - 1)
            if at < 0:
                at = 0
                continue
            x = lens[j - 1]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            now[j] = lines[at][0] * x + lines[at][1] + x * rows[j] - tokens[j]
            cut[j] = lines[at][2]
        if now[m] is None or now[m] >= best[m]:
            break
        best = now
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        bounds.append(lens[j - 1])
        j = cut[j]
        if not j:
            break
    return bounds[::-1]


def _bucket(bounds: list[int], length: Column) -> Column:
    at = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        at = F.when(length <= bounds[k], F.lit(k)).otherwise(at)
    return at


def pack(lengths: DataFrame, buckets: int = 16, max_len: int = 4096, batch_tokens: int = 65_536, seed: int = 5) -> DataFrame:
    """Of (doc_id, n_tokens): doc_id, piece, start, length, bucket, bucket_len, batch_id, place (in the batch).

    ``lengths`` is read several times; pass a written table."""
    spark = lengths.sparkSession
    whole = F.coalesce("n_tokens", F.lit(0)).cast("long") + 1
    seqs = lengths.select("doc_id", whole.alias("whole")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("whole") / max_len).cast("int") - 1)))
    seqs = seqs.select("doc_id", "piece", (F.col("piece").cast("long") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("whole") - F.col("piece").cast("long") * max_len).alias("length"))
    histogram = {r.length: r["count"] for r in seqs.groupBy("length").count().collect()}  # max_len rows at most
    bounds = best_bounds(histogram, buckets) or [max_len]
    per = [max(1, batch_tokens // b) for b in bounds]
    sizes = [0] * len(bounds)
    for length, c in histogram.items():
        sizes[next(k for k, b in enumerate(bounds) if length <= b)] += c
    first, run = [], 0
    for size, n in zip(sizes, per, strict=True):
        first.append(run)
        run += -(-size // n)

    slices = max(16, 2 * shuffle_partitions(spark))
    key = F.xxhash64("doc_id", "piece", F.lit(seed))
    seqs = seqs.withColumn("bucket", _bucket(bounds, F.col("length"))).withColumn("order", key).withColumn("slice", F.pmod("order", F.lit(slices)).cast("int"))
    counts = seqs.groupBy("bucket", "slice").count()
    before = counts.select("bucket", "slice", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("order", "doc_id", "piece", "length"))
    # slices x buckets rows at most: a size fixed by parameters, not by the data
    placed = seqs.withColumn("own", own).join(F.broadcast(before), ["bucket", "slice"]).withColumn("at", F.col("before") + F.col("own") - 1)

    def pick(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])[F.col("bucket")]

    placed = placed.withColumn("per", pick(per))
    return placed.select(
        "doc_id", "piece", "start", "length", "bucket", pick(bounds).alias("bucket_len"),
        (pick(first) + F.floor(F.col("at") / F.col("per"))).alias("batch_id"), F.pmod("at", F.col("per")).alias("place"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, memo: dict[str, int] | None = None, **options) -> DataFrame:
    """Counts tokens of (doc_id, text) and packs them; see ``pack``. ``memo``: bounds of the word memo."""
    from palaver.llm.token_counts import token_counts

    counts = token_counts(docs, tokenizer_path, words=True, **(memo or {})).select("doc_id", "n_tokens")
    return pack(Scratch(docs.sparkSession, "packing").write(counts, "lengths"), **options)
