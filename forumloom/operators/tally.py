"""Counts and shares per forum, null counts per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.schema import FORUM

NULL_COLUMNS = ("subreddit", "post_id", "upvotes", "text")


def count_by(df: DataFrame, group: str = FORUM) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """Add each group's share of all rows; the total is a scalar subquery over the grouped counts."""
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def with_total(counts: DataFrame, group: str = FORUM) -> DataFrame:
    """Append the row ``total``, by rolling up the grouped counts (not the rows behind them)."""
    name = F.when(F.grouping(group) == 1, F.lit("total")).otherwise(F.col(group))
    return (
        counts.rollup(group)
        .agg(F.sum("n").alias("n"), F.grouping(group).alias("is_total"), name.alias("_name"))
        .select(F.col("_name").alias(group), "n", F.col("is_total").cast("int").alias("is_total"))
    )


def by_size(counts: DataFrame, group: str = FORUM) -> DataFrame:
    """Largest first; ties by case-insensitive name, then by name."""
    return counts.orderBy(F.desc("n"), F.lower(group), group)


def by_name(counts: DataFrame, group: str = FORUM) -> DataFrame:
    return counts.orderBy(F.lower(group), group)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    column = F.col(name)
    floating = dict(df.dtypes)[name] in ("float", "double")
    return column.isNull() | F.isnan(column) if floating else column.isNull()


def null_counts(df: DataFrame, columns: Sequence[str] = NULL_COLUMNS) -> DataFrame:
    """``(column, n_nulls)`` in one pass over the table."""
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "n_nulls")


def formatted(counts: DataFrame, group: str = FORUM) -> DataFrame:
    """Counts with thousands separators and shares with two decimals, as text."""
    shown = shares(counts)
    return shown.select(
        group,
        F.format_number("n", 0).alias("n"),
        F.concat(F.format_number(100 * F.col("share"), 2), F.lit("%")).alias("pct"),
    )


def report(df: DataFrame, group: str = FORUM) -> DataFrame:
    """The full tally: formatted rows, largest first, with the total last."""
    counts = count_by(df, group)
    rows = with_total(counts, group)
    total = counts.agg(F.sum("n")).scalar()
    return rows.orderBy("is_total", F.desc("n"), F.lower(group), group).select(
        group,
        F.format_number("n", 0).alias("n"),
        F.concat(F.format_number(100 * F.col("n") / total, 2), F.lit("%")).alias("pct"),
    )
