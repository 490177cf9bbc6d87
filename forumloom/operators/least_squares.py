"""Ridge fits of many targets at once: conjugate gradients in which all targets share each pass over the rows.

The rows are stored once as blocks whose cells are sorted by column: a pass reads the weights of a block's columns in order,
and adds up what comes back column by column, so that neither is looked up cell by cell over the whole width.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.operators.trees import vector_cells, widths
from forumloom.session import ship_package, stage

BLOCK_BYTES = 32 << 20
"""Most bytes of weights that one pass broadcasts and sums; more classes are solved group by group."""

PIECE = 1 << 15
"""Numbers of a sum that are added up together."""

MAX_ITER, TOLERANCE = 500, 1e-8

BLOCK_ROWS = 1 << 14
"""Most rows of a block, numbered in two bytes."""

_BLOCKS = "labels binary, rows binary, cells binary, starts binary, columns binary"
_KINDS = (np.float64, np.uint16, np.float64, np.int64, np.int32)


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of rows ``(features, label)``: labels, and rows and values of the cells by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                yield packed(batch.slice(first, BLOCK_ROWS))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, column, value = vector_cells(pa.concat_arrays([batch.column("features")]))
        order = np.argsort(column, kind="stable")
        columns, starts = np.unique(column[order], return_index=True)
        arrays = (np.asarray(batch.column("label"), np.float64), row[order], value[order], np.append(starts, len(row)), columns)
        made = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(arrays, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(made, [f.split()[0] for f in _BLOCKS.split(", ")])

    return rows.select("features", "label").mapInArrow(run, _BLOCKS)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Labels, rows and values of the cells, cells of each column, where they start, and the columns of each block with cells."""
    for block in zip(*batch.columns, strict=True):
        label, row, value, starts, columns = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(block, _KINDS, strict=True))
        if len(row):
            yield label, row.astype(np.intp), value, np.diff(starts), starts[:-1], columns


def _pass(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], length: int) -> np.ndarray:
    """The sum of ``part``, ``length`` numbers, over all batches.

    A task adds up its own batches; the sums of all tasks meet piece by piece, so the driver gets each number once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = part(batch)
            total = found if total is None else np.add(total, found, out=total)
        for first in range(0, len(total) if total is not None else 0, PIECE):
            piece = total[first : first + PIECE].astype(np.float64, copy=False).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([piece], pa.binary())], ["first", "piece"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, piece in zip(batch.column("first").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                more = np.frombuffer(piece)
                sums[first] = sums[first] + more if first in sums else more
        for first, piece in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([first], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["first", "piece"]
            )

    found = np.zeros(length)
    kind = "first long, piece binary"
    pieces = -(-length // PIECE)
    together = min(pieces, rows.sparkSession.sparkContext.defaultParallelism)
    sums = rows.mapInArrow(run, kind).repartition(together, "first").mapInArrow(add, kind)
    for first, piece in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
        found[first : first + PIECE] = np.frombuffer(piece)
    return found


def column_moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of every column of blocks."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, width))
        for _, _, value, _, starts, columns in _blocks(batch):
            out[0, columns] += np.add.reduceat(value, starts)
            out[1, columns] += np.add.reduceat(value * value, starts)
        return out.ravel()

    total = _pass(rows, part, 2 * width)
    return total[:width], total[width:]


def class_sums(rows: DataFrame, width: int, classes: np.ndarray) -> np.ndarray:
    """Column sums over the rows of each class, one column per class, of blocks."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((width, len(classes)))
        for label, row, value, _, starts, columns in _blocks(batch):
            for k, c in enumerate(classes):
                out[columns, k] += np.add.reduceat(value * (label == c)[row], starts)
        return out.ravel()

    return _pass(rows, part, width * len(classes)).reshape(width, len(classes))


def gram_times(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """X'(XP) for the columns of ``weights``, in one pass over blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        p = shared.value
        out = np.zeros(p.shape)
        for label, row, value, sizes, starts, columns in _blocks(batch):
            own, sums = p[columns], np.empty((len(columns), p.shape[1]))
            for k in range(p.shape[1]):
                score = np.bincount(row, value * np.repeat(own[:, k], sizes), len(label))
                sums[:, k] = np.add.reduceat(value * score[row], starts)
            out[columns] += sums
        return out.ravel()

    try:
        return _pass(rows, part, weights.size).reshape(weights.shape)
    finally:
        shared.destroy()  # every pass has weights of its own: the driver must not keep them


def solve(
    times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, diagonal: np.ndarray, tolerance: float, max_iter: int
) -> np.ndarray:
    """Conjugate gradients for every column of ``right``; a column leaves once its residual is ``tolerance`` of its start.

    ``times`` multiplies by the matrix, ``diagonal`` is the matrix's and scales the residuals.
    """
    found, residual = np.zeros_like(right), right.copy()
    bound = tolerance * np.linalg.norm(right, axis=0)
    towards = residual / diagonal[:, None]
    size = (residual * towards).sum(axis=0)
    for _ in range(max_iter):
        live = np.flatnonzero(np.linalg.norm(residual, axis=0) > bound)
        if not len(live):
            return found
        p = towards[:, live]
        q = times(p)
        step = size[live] / (p * q).sum(axis=0)
        found[:, live] += step * p
        residual[:, live] -= step * q
        scaled = residual[:, live] / diagonal[:, None]
        now = (residual[:, live] * scaled).sum(axis=0)
        towards[:, live] = scaled + now / size[live] * p
        size[live] = now
    if (np.linalg.norm(residual, axis=0) > bound).any():
        warnings.warn(f"ridge: no convergence in {max_iter} iterations", stacklevel=2)
    return found


class RidgeClassifier:
    """Weights (columns by classes) and intercepts; the largest score wins, ties go to the smallest class."""

    def __init__(self, classes: np.ndarray, weights: np.ndarray, intercepts: np.ndarray):
        self.classes, self.weights, self.intercepts = classes, weights, intercepts

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.classes, self.weights, self.intercepts))

        @F.arrow_udf("double")
        def judge(vectors: pa.Array) -> pa.Array:
            classes, weights, intercepts = shared.value
            row, column, value = vector_cells(vectors)
            known = column < len(weights)
            row, column, value = row[known], column[known], value[known]
            best, chosen = np.full(len(vectors), -np.inf), np.zeros(len(vectors), np.int64)
            for k in range(len(classes)):
                score = np.bincount(row, value * weights[column, k], len(vectors)) + intercepts[k]
                higher = score > best
                best[higher], chosen[higher] = score[higher], k
            return pa.array(classes[chosen])

        return df.withColumn("prediction", judge("features"))


def ridge_classifier(
    train: DataFrame, alpha: float = 1.0, tolerance: float = TOLERANCE, max_iter: int = MAX_ITER
) -> RidgeClassifier:
    """One ridge target of -1/+1 per class, with an intercept; penalty ``alpha`` * |w|^2 on the summed squared error.

    The centred matrix is never made: the mean's part is taken off each product. Classes are solved together, in
    groups whose weights stay below ``BLOCK_BYTES``, so an iteration is one pass for a whole group. Rows without a
    label or features are not fitted; without any row there is nothing to fit and that is an error.
    """
    ship_package(train.sparkSession)
    rows = train.select("features", F.col("label").cast("double").alias("label")).where("features IS NOT NULL AND label IS NOT NULL")
    rows = stage(rows, "ridge")
    blocks = pack(rows).persist()
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = blocks.coalesce(cores) if blocks.rdd.getNumPartitions() > cores else blocks  # each sends sums as wide as the features
    try:
        counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per class
        if not counts:
            raise ValueError("no labelled rows to fit")
        widest = F.arrow_udf(widths, "long")
        width = max(int(rows.agg(F.max(widest("features"))).first()[0]), 1)
        classes, n = np.array(sorted(counts)), sum(counts.values())
        sums, squares = column_moments(parts, width)
        mean = sums / n
        diagonal = np.maximum(squares - n * mean * mean, 0.0) + alpha
        diagonal[diagonal <= 0] = 1.0

        def times(p: np.ndarray) -> np.ndarray:
            return gram_times(parts, p) - n * np.outer(mean, mean @ p) + alpha * p

        together = max(1, BLOCK_BYTES // (8 * width))
        weights, intercepts = np.zeros((width, len(classes))), np.zeros(len(classes))
        for start in range(0, len(classes), together):
            own = slice(start, start + together)
            target_mean = np.array([2.0 * counts[c] / n - 1.0 for c in classes[own]])
            right = 2.0 * class_sums(parts, width, classes[own]) - sums[:, None] - n * np.outer(mean, target_mean)
            weights[:, own] = solve(times, right, diagonal, tolerance, max_iter)
            intercepts[own] = target_mean - mean @ weights[:, own]
        return RidgeClassifier(classes, weights, intercepts)
    finally:
        blocks.unpersist()
