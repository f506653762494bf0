"""The corpus pipeline: five operators in a row over the documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet and reread as the next
stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import decontam, packing, quality, secrets, simhash
from melisma.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's frequent lines; n_chars follows the text."""
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; repeated rows of it count once."""
    copies = simhash.groups(docs).where("doc_id != group_id").select("doc_id")
    return docs.where(F.col("doc_id").isNotNull()).join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    leaking = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.where(F.col("doc_id").isNotNull()).join(leaking, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by markers; n_chars follows the text."""
    masked = secrets.mask(docs)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return (masked.withColumn("n_chars", changed) if "n_chars" in docs.columns else masked).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Near-duplicate groups, the latent space, inferred automata and token ids have no SQL form; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
