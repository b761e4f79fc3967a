"""Token counts: lengths of every whole text under a public tokenizer, without keeping ids.

Arrow functions get record batches, re-cut to about equal bytes, and give each to the library; texts longer than a batch are
split at boundaries that the vocabulary never crosses. A scan, one Arrow stage, a result. ``words``
takes the word memo of ``tokens`` instead, where the vocabulary is of that kind; the counts are the same. A scan of fewer
tasks than cores (a file of one row group) is dealt evenly first.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows with a null or repeated id each give a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import bounded_batches, filled, freed, spread
from palaver.llm.tokens import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", words: bool = False, **bounds: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row; ``bounds`` are those of the word memo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, words, **bounds)
        for b in batches:
            texts = filled(b.column(1))
            counts, _ = enc.encode(texts, want_ids=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(freed(run), SCHEMA)


def with_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds over_limit, whether a text has more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
