"""From raw documents to packed training batches: five stages, each one corpus operator.

Stages are read from Parquet and written to Parquet; each works on all rows its predecessor kept, and all but the last
return the columns of documents. Toxic rows go; of equal texts one row stays; of linked near-duplicates one row stays
(null and repeated ids join nothing: rows are told apart by a number that the stage gives them); the mixture
repeats documents of domains below their target weight (no document goes); packing gives the batches.

Defined cases: a null text is an empty one: the toxicity stage keeps it (it scores by the bias alone), all empty texts are
copies of one another, and it packs as one end token. Rows with null or repeated ids are rows of their own in the first
three stages; the mixture gives rows that share an id one rate. Extra columns of documents pass through all but the last
stage, whatever their names (but for the row number's). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import queries
from palaver.llm.common import Scratch
from palaver.llm.exact_dedup import exact_dedup
from palaver.llm.jaccard import near_duplicates
from palaver.llm.mixing import apply_copies, mixture
from palaver.llm.packing import pack_documents
from palaver.llm.toxicity import without_toxic


#: The row number that a stage gives, keeps in its stored copy and takes off again; no column of documents has this name.
ROW = "__row"


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A stored copy of docs with a number for each row, so that every reading meets the same numbers."""
    return scratch.write(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _one_each(numbered: DataFrame, groups: DataFrame, *order: Column) -> DataFrame:
    """Of each group of (row, group) the row that is first by order, smallest doc_id (null last) and number."""
    doc_id = F.col("doc_id").cast("long")
    keys = [k.alias(f"k{i}") for i, k in enumerate([*order, doc_id.isNull(), doc_id, F.col(ROW)])]
    placed = numbered.select(ROW, F.struct(*keys).alias("at")).join(groups, ROW)
    kept = placed.groupBy("group").agg(F.min("at").alias("at")).select(F.col(f"at.k{len(keys) - 1}").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in numbered.columns if c != ROW])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are scored and filtered where they are read, so an id decides nothing."""
    return without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the most code points stays, then the one with the smallest doc_id."""
    scratch = Scratch(spark, "copies")
    rows = _numbered(docs, scratch)
    found = exact_dedup(rows.select(F.col(ROW).alias("doc_id"), "text"), scratch=scratch)
    groups = scratch.write(found.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")), "groups")
    scratch.drop("spill")
    return _one_each(rows, groups, -F.length(F.coalesce("text", F.lit(""))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are documents of their own; of each component the one with the smallest doc_id stays."""
    scratch = Scratch(spark, "near-copies")
    rows = _numbered(docs, scratch)
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    return _one_each(rows, found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """To the target weights of op10, with no rate below 1."""
    plan = mixture(docs, queries.labelled_domains(spark, sf_dir), queries.TARGETS, keep_all=True)
    return apply_copies(docs, plan)


#: Workers keep the word memo when packing has ended, beside executors that the other stages have filled: a quarter of the
#: usual words and batches. Counts are the same.
MEMO = {"max_words": 150_000, "batch_bytes": 2_000_000}


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, queries.tokenizer_path(), memo=MEMO)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained classifiers and dynamic programming have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared folder and read again. What a stage leaves
    there goes when its result is stored, and that result when the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with Scratch.together():
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
