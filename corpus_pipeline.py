"""A corpus pipeline: language, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.llm import decontaminate, language, minhash, packing, secrets
from forumloom.llm.common import learnable
from forumloom.session import staging_path


FLOOR, SHORT_FLOOR, SHORT = 0.15, 0.02, 200
"""Least cosine of texts of at least ``SHORT`` characters, and of shorter ones, whose few trigrams tell little.

Calibrated on learnable rows: the least cosine at sf0.1 is 0.212 from 200 characters on and 0.053 below (0.049 at
sf0.01). With the profiles of sf0.01, random letters of 300 to 10,000 characters and Russian and Polish texts of 285
stay below 0.12. Short foreign texts may pass: 120 Chinese characters have 0.036, 100 random letters 0.060.
"""


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a language profile; ``und`` and cosines below the floor are rejected."""
    profiles = language.train_profiles(docs.where(learnable()))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # own columns named like the new ones stay
    found = language.identify(docs.select(row, "text"), profiles)
    floor = F.when(F.length("text") >= SHORT, FLOOR).otherwise(SHORT_FLOOR)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= floor)).select("_row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group; rows that repeat an id stay together."""
    dropped = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark)
    return found.where(F.size("covered") == 0).select(docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(docs).where(F.size("spans") == 0).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", no_benchmark_passages),
    ("secrets", no_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
