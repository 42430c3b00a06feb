"""Five stages from raw documents to a mixture, each one operator of linepatterns.llm.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last returns what the mixture takes
of each document. Stages are written as Parquet and read again, so a lost executor costs one stage at most.

Columns that documents has beyond those of the contract are kept whatever their names, as operators get only the columns they
read, and rows are met again by id and text. Null texts fail the quality rules; null ids and repeated rows are rows like any other,
except that of near duplicates one row stays. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepatterns.llm import decontaminate, mixing, pii, quality_rules, simhash_dedup
from linepatterns.sources.shared import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality_rules.kept(docs, trusted)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more), one row stays: that with the smallest doc_id, nulls last, then the smallest text, then any of equal rows."""
    return simhash_dedup.one_of_each(docs, width=5, similar=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    return pii.masked_documents(docs, length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document."""
    return mixing.mixture(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("pii", mask_pii), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
