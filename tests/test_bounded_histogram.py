"""Histograms whose size depends on the values, not on their range."""

from pyspark.sql import functions as F

from forumloom.operators import series


def test_an_outlier_costs_one_bin(spark):
    values = [0.0, 0.2, 0.25, -0.1, 1e12, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = sorted((r.bin, r.lower, r.n) for r in series.occupied_bins(df, "v", 0.25).collect())
    assert found == [(-1, -0.25, 1), (0, 0.0, 2), (1, 0.25, 1), (4 * 10**12, 1e12, 1)]
    assert series.occupied_bins(df.limit(0), "v", 1.0).count() == 0


def test_quantile_edges_hold_equal_shares(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 999, 1e12).otherwise(F.col("id").cast("double")).alias("v"))
    edges = series.quantile_edges(df, "v", 4).first().edges
    assert len(edges) == 5 and edges[0] == 0 and edges[-1] == 1e12 and all(abs(e - 250 * i) <= 2 for i, e in enumerate(edges[:4]))
    assert series.quantile_edges(df.limit(0), "v", 4).first().edges == []
    assert series.quantile_edges(df.select(F.lit(3.0).alias("v")), "v", 4).first().edges == [3.0]
