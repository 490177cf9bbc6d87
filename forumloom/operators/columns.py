"""The columns that occur: wide hashed features renumbered for estimators that keep a number per column.

A column without a value in the train rows has weight zero in every linear learner here (they start from zero and
its gradient is the penalty's alone), and no tree can split it. Leaving it out changes no prediction, but a
hashed width of 2^20 shrinks to the words that are there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.operators import features
from forumloom.operators.order import with_positions
from forumloom.operators.skew import HOT_SHARE, fits_broadcast, join_lookup
from forumloom.schema import KEY
from forumloom.session import ship_package, stage

MAX_COLUMNS = 1 << 21
"""Most columns whose numbers are sent to the tasks, 16 bytes each."""


@dataclass(frozen=True)
class Columns:
    """``table`` has ``term_idx, column, n`` (train cells of the column); columns run from 0 in order of ``term_idx``."""

    table: DataFrame
    width: int


def fit_columns(train: DataFrame) -> Columns:
    """The columns with a value other than zero in ``train``, numbered by a range sort; nothing passes the driver."""
    counts = train.where(F.col("value") != 0).groupBy("term_idx").agg(F.count(F.lit(1)).alias("n"))
    table = with_positions(counts, ["term_idx"], "column")
    return Columns(table, max(table.count(), 1))


def renumber(cells: DataFrame, columns: Columns) -> DataFrame:
    """``cells`` over the occurring columns; cells of other columns drop out.

    A checked table is broadcast; a larger one is joined with its frequent columns spread out.
    """
    table = columns.table.select("term_idx", "column")
    if fits_broadcast(table, features.MAX_BROADCAST_TERMS):
        joined = cells.join(F.broadcast(table), "term_idx")
    else:
        total = columns.table.agg(F.sum("n")).scalar()
        hot = columns.table.where(F.col("n") * HOT_SHARE > total).select("term_idx")
        joined = join_lookup(cells, table, ["term_idx"], hot=hot)
    return joined.select(*[F.col("column").alias(c) if c == "term_idx" else F.col(c) for c in cells.columns])


def compact_vectors(cells: DataFrame, columns: Columns, ids: DataFrame, key: str = KEY) -> DataFrame:
    """One sparse vector of ``columns.width`` per id; ids without an occurring column have an empty one."""
    return features.sparse_vectors(renumber(cells, columns), columns.width, key, ids=ids)


def vectors_in_rows(bags: DataFrame, columns: Columns, name: str = "features") -> DataFrame:
    """``bags`` with a sparse vector of ``columns.width`` in place of ``cells``, its cells sorted by ``term_idx``.

    The numbers of up to ``MAX_COLUMNS`` columns go to the tasks, so no row and no cell moves. More columns are joined,
    and the cells of a row meet again under a number of its own.
    """
    others = [c for c in bags.columns if c != "cells"]
    if not fits_broadcast(columns.table, MAX_COLUMNS):
        numbered = stage(bags.withColumn("_row", F.monotonically_increasing_id()), "bags")
        cells = numbered.select("_row", F.inline("cells"))
        return numbered.join(compact_vectors(cells, columns, numbered, "_row"), "_row").select(*others, F.col("features").alias(name))
    ship_package(bags.sparkSession)
    table = columns.table.select("term_idx", "column").orderBy("term_idx").toArrow()  # bounded: checked above
    known, number = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("term_idx", "column"))
    shared = bags.sparkSession.sparkContext.broadcast((known, number.astype(np.int32)))
    width = columns.width

    @F.arrow_udf(VectorUDT())
    def compact(cells: pa.Array) -> pa.Array:
        known, number = shared.value
        flat, sizes = cells.flatten(), np.asarray(cells.value_lengths().fill_null(0), np.int64)
        row, index = np.repeat(np.arange(len(sizes)), sizes), np.asarray(flat.field("term_idx"), np.int64)
        place = np.minimum(np.searchsorted(known, index), max(len(known) - 1, 0))
        there = known[place] == index if len(known) else np.zeros(len(index), bool)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[there], minlength=len(sizes)))]).astype(np.int32))
        indices = pa.ListArray.from_arrays(offsets, pa.array(number[place[there]], pa.int32()))
        values = pa.ListArray.from_arrays(offsets, pa.array(np.asarray(flat.field("value"), np.float64)[there]))
        kind, size = np.zeros(len(sizes), np.int8), np.full(len(sizes), width, np.int32)
        return pa.StructArray.from_arrays([pa.array(kind), pa.array(size), indices, values], ["type", "size", "indices", "values"])

    return bags.select(*others, compact("cells").alias(name))


def column_weights(weights: Vector, columns: Columns) -> DataFrame:
    """Fitted weights by their wide column, ``(term_idx, weight)``; columns that are not listed have weight 0."""
    spark = columns.table.sparkSession
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights.toArray())], "column long, weight double")
    return columns.table.join(rows, "column").select("term_idx", "weight")
