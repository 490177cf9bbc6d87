"""Summaries of measured series: moments, histograms, rolling means, comparisons, seeded samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumloom.operators.order import with_group_positions, with_positions


def mean_and_std(df: DataFrame, series: str, value: str) -> DataFrame:
    """Mean and sample standard deviation of each series."""
    return df.groupBy(series).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def occupied_bins(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in bins of ``width`` from zero, ``(bin, lower, upper, n)``, of bins that have values only.

    There are at most as many rows as values, however far apart these are. Null, NaN and infinite values are not counted.
    """
    number = F.col(value).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")))
    counts = known.groupBy(F.floor(number / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.col("bin") * width).alias("lower"), ((F.col("bin") + 1) * width).alias("upper"), "n")


def quantile_edges(df: DataFrame, value: str, bins: int, accuracy: int = 10_000) -> DataFrame:
    """``(edges)``: at most ``bins`` + 1 increasing edges between which about equally many values lie.

    From a mergeable quantile sketch, so one pass and one small row per task. Null and NaN values are not counted;
    without values there are no edges.
    """
    number = F.col(value).cast("double")
    shares = [i / bins for i in range(bins + 1)]
    found = df.where(~F.isnan(number)).agg(F.percentile_approx(number, shares, accuracy).alias("q"))
    return found.select(F.coalesce(F.array_sort(F.array_distinct("q")), F.array().cast("array<double>")).alias("edges"))


def histogram(df: DataFrame, value: str, bins_per_unit: int = 4, bins: int | None = None) -> DataFrame:
    """Counts in equal-width bins from floor(min) to ceil(max): ``(bin, lower, upper, n)``.

    Bins are closed on the left and the last one on both sides; empty bins are kept. Without ``bins``
    there are ``bins_per_unit`` bins for each unit of the range. Null and NaN values are not counted; a
    series of one integer value has a range of one unit.
    """
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    edges = df.agg(F.floor(F.min(value)).alias("lo"), F.ceil(F.max(value)).alias("hi"))
    edges = edges.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))
    count = F.lit(bins) if bins else (F.col("hi") - F.col("lo")) * bins_per_unit
    edges = edges.select("lo", "hi", F.greatest(count, F.lit(1)).cast("long").alias("k"))
    lo, k = edges.select("lo").scalar(), edges.select("k").scalar()
    width = edges.select(((F.col("hi") - F.col("lo")) / F.col("k")).cast("double")).scalar()
    index = F.least(F.floor((F.col(value) - lo) / width), k - 1)
    counts = (
        df.select(index.cast("long").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = edges.where("lo IS NOT NULL").agg(F.max("k")).first()[0] or 0  # bins come from a range, spread over the tasks
    frame = df.sparkSession.range(n).select(
        F.col("id").alias("bin"), (lo + F.col("id") * width).alias("lower"), (lo + (F.col("id") + 1) * width).alias("upper")
    )
    return frame.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def rolling_mean(
    df: DataFrame, key: str, order: Sequence[str], value: str, rows: int = 3, name: str = "rolling", chunk: int = 65_536
) -> DataFrame:
    """Mean over the last ``rows`` rows of each key; null until there are that many.

    Keys are cut into chunks of consecutive rows and the last ``rows`` - 1 rows of a chunk are copied to
    the next one, so a key of any length is spread over many tasks.
    """
    if chunk < rows:
        raise ValueError("a chunk must hold at least one window")
    placed = with_group_positions(df, [key], list(order), "_pos")
    own = F.floor(F.col("_pos") / chunk)
    spills = (F.col("_pos") % chunk) >= chunk - (rows - 1)
    copies = placed.withColumn(
        "_chunk", F.explode(F.when(spills & F.lit(rows > 1), F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(key, "_chunk").orderBy("_pos").rowsBetween(-(rows - 1), 0)
    mean = F.when(F.col("_pos") >= rows - 1, F.avg(value).over(window))
    return copies.withColumn(name, mean).where(F.col("_chunk") == own).select(*df.columns, name)


def compare(df: DataFrame, first: str, second: str) -> DataFrame:
    """``delta`` = second - first, and which of the two is smaller."""
    delta = F.col(second) - F.col(first)
    return df.withColumn("delta", delta).withColumn("first_is_less", delta > 0).withColumn("second_is_less", delta < 0)


def hash_number(*parts: Column | str) -> Column:
    """A 32-bit number from the MD5 of the parts joined by ``:``; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def sample_with_replacement(df: DataFrame, n: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` seeded draws: draw i takes the row at position hash(seed, i) modulo the row count."""
    placed = with_positions(df, list(order), "_pos")
    size = placed.count()
    first, second = hash_number(F.lit(str(seed)), F.col("draw").cast("string")), hash_number(
        F.lit(f"{seed}b"), F.col("draw").cast("string")
    )
    # two 31-bit numbers give enough range for tables of any size
    wide = F.shiftright(first, 1) * F.lit(1 << 31) + F.shiftright(second, 1)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_pos", F.pmod(wide, F.lit(size)))
    return draws.join(placed, "_pos").drop("_pos").select("draw", *df.columns)


def per_batch(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a pandas function on Arrow batches of rows.

    What the rows of a forum need one by one needs no grouping: no shuffle, and no task owns a whole forum.
    """

    def run(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


