"""Reading comment tables, id lists, features and forum lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.schema import COMMENT_SCHEMA, FORUM

PARQUET_FILES = "*.{parquet,parquet.gz}"
"""Only these files are read; anything else lying in the folders is ignored."""


def _table(spark: SparkSession, base: str, paths: Sequence[str]) -> DataFrame:
    return (
        spark.read.schema(COMMENT_SCHEMA)
        .option("basePath", base)
        .option("pathGlobFilter", PARQUET_FILES)
        .parquet(*paths)
        .select(*COMMENT_SCHEMA.names)
    )


def read_comments(
    spark: SparkSession, where: str | Sequence[str], forums: Sequence[str] | str | None = None
) -> DataFrame:
    """Comments below a parent folder, or in a list of forum folders (``.../subreddit=name``).

    The folder that holds the ``subreddit=`` folders is the base path, so that the forum column survives.
    ``forums`` is a list of names or a pattern with ``*``; it prunes folders, not rows.
    """
    if isinstance(where, str):
        df = _table(spark, where, [where])
    else:
        parents: dict[str, list[str]] = {}
        for path in where:
            parents.setdefault(path.rstrip("/").rpartition(f"/{FORUM}=")[0] or path, []).append(path)
        df = reduce(DataFrame.unionByName, [_table(spark, base, paths) for base, paths in parents.items()])
    if forums is None or forums == "*":
        return df
    if isinstance(forums, str):
        pattern = forums.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return df.where(F.col(FORUM).like(pattern))
    return df.where(F.col(FORUM).isin(list(forums)))


def read_forum_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one forum per line; blank lines are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias(FORUM))
    return lines.where(F.col(FORUM) != "").distinct()


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Long features written by ``write_features``; a split is one folder."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
