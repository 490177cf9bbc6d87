"""Joins and key selections that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key is hot when it owns more than one row in ``HOT_SHARE``; so there are fewer than that many hot keys."""

SALTS = 64


def hot_keys(big: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Keys owning more than 1/``HOT_SHARE`` of the rows of ``big``: at most ``HOT_SHARE`` - 1 of them.

    ``weight`` lets a pre-aggregated table stand for the rows it was built from.
    """
    counts = big.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * HOT_SHARE > total).select(*keys)


def join_lookup(
    big: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join ``big`` to a table with one row per key, spreading hot keys over ``salts`` partitions.

    Rows of ``big`` with a hot key draw a salt from a hash of the whole row; ``lookup`` repeats only its
    hot rows. The list of hot keys is broadcast: its length is bounded by ``HOT_SHARE`` whatever the data.
    One shuffle per side, like the plain join.
    """
    keys = list(keys)
    hot = hot if hot is not None else hot_keys(big, keys)
    hot = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(F.lit(0)))
        .drop("_hot")
    )
    right = (
        lookup.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(
                    F.array(F.lit(0).cast("long"))
                )
            ),
        )
        .drop("_hot")
    )
    left = left.withColumn("_salt", F.col("_salt").cast("long"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than ``max_rows`` + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def collect_if_small(df: DataFrame, max_rows: int, max_bytes: int) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``max_rows`` of at most ``max_bytes`` of text, else ``None``.

    Both are checked before anything but two numbers is collected; ``df`` is computed once, no further than that.
    """
    texts = [name for name, kind in df.dtypes if kind == "string"]
    size = sum((F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long") for name in texts), F.lit(0).cast("long"))
    some = df.limit(max_rows + 1).persist()
    try:
        rows, total = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        return some.toArrow() if rows <= max_rows and total <= max_bytes else None
    finally:
        some.unpersist()


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame | None:
    """``df`` with a broadcast hint when its checked size allows it, else ``None``."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else None


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The smallest row of each key in the given order, ties broken by all remaining columns.

    An aggregate of structs, not a window: each task reduces its rows to one per key before the shuffle,
    so a key owning a third of the table costs one row per task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best._row.{c}").alias(c) for c in df.columns])
