"""A training-data pipeline of the operators in genolith.llm: each stage is written and read again by the next one.

Quality rules drop what they reject, near duplicates leave one document of each group, contaminated documents go and
shorter benchmark passages are cut out, secrets are replaced by a mark, and what remains is packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm import decontamination, neardup, packing, quality, secrets
from genolith.llm.shared import shared_dir, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the perplexity bands keep."""
    ship(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near duplicates."""
    ship(spark)
    return neardup.keep(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; shorter benchmark passages are cut from the text."""
    ship(spark)
    return recounted(decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and access identifiers replaced by a mark."""
    ship(spark)
    return recounted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    ship(spark)
    return packing.pack(packing.pieces(docs).drop("ids"))


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret scans", secrets_redacted),
    ("packing", packed),
]

#: The stages train a model, tokenize and plan; no SQL expresses them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/genolith/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
