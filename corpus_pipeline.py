"""A training corpus from ``documents``: five operators in a row.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor
wrote, and returns a DataFrame.  All but the last return the columns of
``documents``, whatever they are called; the last returns the packed pieces.

Defined results: an empty table stays empty; a null text is empty text; without
labels nothing is toxic.  Where identifiers are null or repeat, rows are told
apart by a stored number: of equal or near texts the row with the smallest
identifier stays (null is larger than any other), of rows that share it the
first stored one.  Repeated rows are copies.  Every other row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrec.llm import exact_dedup, packing, secrets, simhash, toxicity
from lumenrec.llm.common import new_path

#: Two stages are learned models, so SQL cannot state run()'s rows; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def reject_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def reject_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a 1024-token sequence."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", reject_copies),
    ("simhash", reject_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
