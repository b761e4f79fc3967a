"""Mixing to target weights by soft membership, in DataFrame operations only.

1. A classifier learns domains from a labelled table: multinomial naive Bayes over hashed words, on a bounded sample of
   labelled rows (rows whose hash falls below sample_rows / labelled rows). Its table has ``buckets`` rows at most.
2. Every document's words meet that table; the sums, tempered to the evidence of ``evidence`` words, give posteriors.
3. Rates: minimise the squared gaps between the expected domain token totals, sum of rate x tokens x posterior, and the
   targets, over rates >= ``least``, by projected gradient steps from rates of 1. The gradient of a document's rate is its
   posterior times the gaps, scaled by its tokens; a step divides that scale out and multiplies the gaps by the inverse of
   the documents' spread (sum of tokens x posterior x posterior over the rates that are free), so that a few steps do. All
   steps so far add up to one number a domain, so a rate is max(least, 1 + their product with the posterior): a step needs
   one sum over all documents, writes no state, and nothing per document reaches the driver. A step that does not make the
   gap smaller is halved.

Steps go on until the totals of the rates themselves are within ``tolerance`` of the targets. Where ten halvings bring
nothing, posteriors cannot give the targets: the fit ends with a warning that names the totals reached.

With ``keep_all`` no rate is below 1 and the total grows to what the scarcest domain needs, and on by a twentieth at a time
where mixed posteriors need more (at most to its double); otherwise the total stays.
Rates become copies by rounding with a hash of the document, so the expectation holds.

Defined cases: null, empty and blank texts have 0 tokens, the prior as posterior and weigh nothing; rows that share a
doc_id (null too) are one document and get one rate; labels outside the targets are left out; without labels posteriors
are uniform; an empty table gives an empty plan.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch


@dataclass(frozen=True)
class MixParams:
    buckets: int = 4096
    sample_rows: int = 10_000
    evidence: float = 24.0
    tolerance: float = 2e-4
    seed: int = 11


def _words(docs: DataFrame, *kept: str) -> DataFrame:
    return docs.select(*kept, F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+")).alias("word"))


def _bucket(params: MixParams) -> Column:
    return F.pmod(F.xxhash64(F.lower("word")), F.lit(params.buckets)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], params: MixParams) -> tuple[DataFrame, list[float], list[float]]:
    """(table of bucket and log-probability by domain, log-probability of a bucket not met, log-priors)"""
    labelled = labelled.select("doc_id", "domain").where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, params.sample_rows / max(labelled.count(), 1))
    # about sample_rows rows whatever the size of the labelled table
    picked = F.broadcast(labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(1_000_000)) < int(share * 1_000_000)))
    words = _words(docs.select("doc_id", "text").join(picked, "doc_id"), "domain").where("word <> ''")
    counts = words.groupBy(_bucket(params).alias("bucket")).pivot("domain", domains).count()
    counts = Scratch(docs.sparkSession, "mixing").write(counts.na.fill(0), "counts")
    totals = counts.agg(*[F.coalesce(F.sum(F.col(f"`{d}`")), F.lit(0)).alias(d) for d in domains]).first()
    mass = [t + params.buckets for t in totals]
    table = counts.select("bucket", F.array(*[F.log((F.col(f"`{d}`") + 1) / F.lit(float(m))) for d, m in zip(domains, mass, strict=True)]).alias("w"))
    known = {r.domain: r["count"] for r in picked.groupBy("domain").count().collect()}
    n = sum(known.values()) + len(domains)
    return table, [float(-np.log(m)) for m in mass], [float(np.log((known.get(d, 0) + 1) / n)) for d in domains]


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], params: MixParams = MixParams()) -> DataFrame:
    """doc_id, n_tokens, p (posterior by domain, in the order of ``domains``), one row per doc_id."""
    table, missing, priors = train(docs, labelled, domains, params)
    hit = _words(docs, "doc_id").withColumn("bucket", F.when(F.col("word") != "", _bucket(params))).join(F.broadcast(table), "bucket", "left")
    sums = hit.groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *[F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(F.col("w")[k], F.lit(m)))).alias(f"s{k}") for k, m in enumerate(missing)])
    temper = F.least(F.lit(1.0), F.lit(params.evidence) / F.greatest("n_tokens", F.lit(1)))
    logits = F.array(*[F.lit(q) + F.coalesce(F.col(f"s{k}"), F.lit(0.0)) * temper for k, q in enumerate(priors)])
    odds = sums.select("doc_id", "n_tokens", logits.alias("l")).select("doc_id", "n_tokens", F.transform("l", lambda x: F.exp(x - F.array_max("l"))).alias("o"))
    total = F.aggregate("o", F.lit(0.0), lambda a, x: a + x)
    return odds.select("doc_id", "n_tokens", F.transform("o", lambda x: x / total).alias("p"))


@dataclass
class Fit:
    """Rates as a function of a document's posterior."""

    least: float
    slopes: list[float]

    def free(self) -> Column:
        return F.lit(1.0) + sum((F.lit(float(x)) * F.col("p")[k] for k, x in enumerate(self.slopes)), F.lit(0.0))

    def rate(self) -> Column:
        return F.greatest(F.lit(self.least), self.free())


def fit(members: DataFrame, k: int, targets: list[float] | float, keep_all: bool = False, params: MixParams = MixParams()) -> tuple[Fit, dict]:
    """Rates whose expected totals meet the targets over ``k`` domains: shares by domain, or an exponent that smooths the
    present shares. Also have, want and got (totals), gap (of shares) and passes (over the documents)."""
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    passes = 0

    def sums(at: Fit) -> tuple[np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        open_ = n * (at.free() >= at.least).cast("double")
        row = members.agg(*[F.sum(n * at.rate() * F.col("p")[i]) for i in range(k)], *[F.sum(open_ * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
        spread = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            spread[i, j] = spread[j, i] = x or 0.0
        return np.array([x or 0.0 for x in row[:k]]), spread

    now = Fit(float(keep_all), [0.0] * k)
    got, spread = sums(now)
    have = got
    if have.sum() <= 0:
        return now, {"have": have.tolist(), "want": have.tolist(), "got": have.tolist(), "gap": 0.0, "passes": passes}
    want = np.maximum(have, 0) ** targets if isinstance(targets, float) else np.array(targets, dtype=float)
    want = want / want.sum()
    total = least_total = max(h / w for h, w in zip(have, want, strict=True) if w > 0) if keep_all else have.sum()
    scale = 1.0
    while (gap := np.abs(got / total - want).max()) >= params.tolerance:
        if scale < 1e-3:
            if not keep_all or total >= 2 * least_total:
                warnings.warn(f"targets {want.round(4).tolist()} not reached: {(got / got.sum()).round(4).tolist()} after {passes} passes", stacklevel=2)
                break
            total, scale = 1.05 * total, 1.0
        # the ridge leaves directions alone in which nothing is free
        step = np.linalg.solve(spread + np.eye(k) * max(np.trace(spread), 1.0) * 1e-9, want * total - got)
        ahead = Fit(now.least, (np.array(now.slopes) + scale * step).tolist())
        new, new_spread = sums(ahead)
        if np.linalg.norm(new - want * total) < (1 - scale / 4) * np.linalg.norm(got - want * total):
            now, got, spread, scale = ahead, new, new_spread, min(1.0, 2 * scale)
        else:
            scale /= 2
    return now, {"have": have.tolist(), "want": (want * total).tolist(), "got": got.tolist(), "gap": float(gap), "passes": passes}


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], exponent: float | None = None, keep_all: bool = False, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, n_tokens, p, domain (likeliest), rate and copies, one row per doc_id. With ``exponent`` the present shares
    to that power replace the weights of ``targets``, whose keys still name the domains."""
    domains = sorted(targets)
    members = Scratch(docs.sparkSession, "mixing").write(memberships(docs, labelled, domains, params), "members")
    fitted, _ = fit(members, len(domains), exponent if exponent is not None else [targets[d] for d in domains], keep_all, params)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(params.seed + 1)), F.lit(1 << 40)) / float(1 << 40)
    out = members.withColumn("rate", fitted.rate())
    out = out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    likeliest = F.array(*map(F.lit, domains))[(F.array_position("p", F.array_max("p")) - 1).cast("int")]
    return out.select("doc_id", "n_tokens", "p", likeliest.alias("domain"), "rate", "copies")


def apply_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as its document's copies say; columns as they were."""
    # the row travels as one column, so that no name of docs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rated = plan.select(F.col("doc_id").alias("id"), "copies")
    joined = rows.join(rated, F.col("row.doc_id").eqNullSafe(F.col("id"))).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
