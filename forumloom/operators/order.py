"""Dense positions in a total order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumloom.operators.skew import join_lookup
from forumloom.session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def with_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (which should be a total order).

    Range-partition and sort, number rows inside each partition, cut the lineage so that the boundaries
    cannot move, then add the sizes of the preceding partitions. Only one count per partition is broadcast.
    The order may start with a grouping column: a large group spans partitions like any other rows.
    """
    spark = df.sparkSession
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    numbered = numbered.withColumn("_part", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a few thousand at most, so this window is small whatever the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_mid", "_offset")
    )


def with_group_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row inside its group, whatever the size of the group."""
    placed = with_positions(df, [*group, *order], "_global")
    placed = placed.withColumn("_group", F.struct(*group))  # a struct of null equals itself: rows without a group stay
    starts = placed.groupBy("_group").agg(F.min("_global").alias("_start"))
    return (
        join_lookup(placed, starts, ["_group"])
        .withColumn(name, F.col("_global") - F.col("_start"))
        .drop("_global", "_start")
        .select(*df.columns, name)
    )
