"""The corpus operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.embeddings import OP5_SQL
from palaver.llm.exact_dedup import OP6_SQL
from palaver.llm.filter_audit import OP13_SQL
from palaver.llm.hard_negatives import OP11_SQL
from palaver.llm.jaccard import OP8_SQL
from palaver.llm.warc import OP12_SQL

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Any key gives consistent surrogates; a deployment passes its own secret.
PII_KEY = "palaver-demo-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.token_binary import encode_to_shards

    return encode_to_shards(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.token_counts import token_counts, with_limit

    return with_limit(token_counts(table(spark, sf_dir, "documents"), tokenizer_path()))


#: Shares of the domains in the mixture of op10.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.15, "fr": 0.25}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the rows in the label table; their language is the domain."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.warc import archive_digests

    return archive_digests(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_token_binary": op2_token_binary,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op5_embedding_near_dedup": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_filter_audit": OP13_SQL}
