"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and the L1 term leave a few thousand weights at most, which go with every task. Defined cases: as
for quality; a null or empty text scores by the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import freed
from palaver.llm.ftrl import Ftrl, Grams, Hasher, Model, remainder, score, train

GRAMS = Grams(ngram=2, skip=1)
PARAMS = Ftrl(alpha=3.0, l1=2.0, step=100.0)
THRESHOLD = 0.5


def _held() -> Column:
    return remainder(5) == 0


def learn(docs: DataFrame, labels: DataFrame, params: Ftrl = PARAMS) -> Model:
    return train(docs, labels.where(~_held()), "toxic", GRAMS, params)


def classify_toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = PARAMS) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 5 = 0, never learned from), score, predicted (score >= 0.5)."""
    model = learn(docs, labels, params)
    return score(docs, model).select("doc_id", F.coalesce(_held(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, params: Ftrl = PARAMS) -> DataFrame:
    """The rows of docs that score below 0.5, all columns as they were; no join, so null and repeated ids do not matter."""
    model, at = learn(docs, labels, params), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(model.grams)
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at), hasher) < THRESHOLD))

    return docs.mapInArrow(freed(run), docs.schema)
