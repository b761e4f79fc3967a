"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

Defined cases: a null or empty text scores by the bias alone; rows with a null id are scored and are not held out; label
rows that are null, not 0 or 1, or repeated for an id count once or not at all; without labels every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.ftrl import Ftrl, Grams, remainder, score, train

GRAMS = Grams(ngram=2)
PARAMS = Ftrl()
THRESHOLD = 0.7


def classify_quality(docs: DataFrame, labels: DataFrame, params: Ftrl = PARAMS) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 4 = 2, never learned from), score, predicted (score >= 0.7)."""
    held = remainder(4) == 2
    model = train(docs, labels.where(~held), "quality", GRAMS, params)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
