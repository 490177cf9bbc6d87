"""Spark's multi-layer perceptron fitted over sparse rows.

Spark's own fit keeps every train row as a dense vector, 8 bytes a feature whatever the row holds. Here the train rows are
stored once as blocks of cells on the executors' disks, and a pass makes a few blocks at a time dense; a wide block is dense
over the columns that occur in it alone. Initial weights, blocks, objective, optimiser and the fitted model are Spark's.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import classification as C
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.operators.least_squares import _pass
from forumloom.operators.trees import softmax, vector_cells, widths
from forumloom.session import ship_package

MEMORY = 10
"""Steps that the optimiser remembers: twice as many vectors as long as the weights, on the driver."""

LATEST = 20
"""Values of the objective that must lie within the tolerance."""

SEARCH = 10
"""Most steps of a line search, and most cuts of the interval it finds."""

ENOUGH, FLATTER = 1e-4, 0.9
"""The strong Wolfe conditions: decrease and slope that end a line search."""

DENSE = 1 << 21
"""Most numbers of blocks that are made dense together; a block alone may have more."""

_KINDS = (np.int32, np.int32, np.int32, np.float64, np.int64)
_BLOCKS = "labels binary, sizes binary, places binary, cells binary, columns binary"

Weights = np.ndarray


class SearchFailed(Exception):
    """No step along a direction meets the conditions."""


# Blocks ----------------------------------------------------------------------------------------------


def _packed(batch: pa.RecordBatch, width: int, classes: int) -> pa.RecordBatch:
    vectors, label = batch.columns
    labels = np.asarray(label, np.float64)
    if vectors.null_count or not ((labels >= 0) & (labels < classes) & (labels == np.floor(labels))).all():
        raise ValueError("a perceptron needs features and whole labels from 0 in every row")
    if (np.asarray(widths(vectors)) != width).any():
        raise ValueError(f"features are not all {width} wide")
    row, column, value = vector_cells(vectors)
    if ((np.diff(row) == 0) & (np.diff(column) <= 0)).any():
        raise ValueError("columns of a vector repeat")
    columns, place = np.unique(column, return_inverse=True)
    arrays = (labels.astype(np.int32), np.bincount(row, minlength=len(labels)).astype(np.int32), place.astype(np.int32), value, columns)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], [f.split()[0] for f in _BLOCKS.split(", ")])


def pack(train: DataFrame, width: int, classes: int, size: int, features: str = "features", label: str = "label") -> DataFrame:
    """Blocks of ``size`` rows in the order of each partition (the last one smaller): the cells other than zero alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.concat_batches([*rest, batch])
            full = len(rows) // size * size
            for first in range(0, full, size):
                yield _packed(rows.slice(first, size), width, classes)
            rest = [rows.slice(full)]
        for rows in rest:
            if len(rows):
                yield _packed(rows, width, classes)

    return train.select(F.col(features), F.col(label).cast("double")).mapInArrow(run, _BLOCKS)


# Passes ----------------------------------------------------------------------------------------------


def _layers(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of weights (inputs by outputs) and intercepts of each layer, as Spark lays them out."""
    found, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        ends = at + n_in * n_out
        found.append((flat[at:ends].reshape(n_in, n_out), flat[ends : ends + n_out]))
        at = ends + n_out
    return found


def _stacks(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Consecutive blocks that are made dense together: labels, shares, dense rows and which columns those are."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for block in zip(*batch.columns, strict=True):
        arrays = [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(block, _KINDS, strict=True)]
        if held and (rows + len(arrays[0])) * width > DENSE:
            yield _stacked(held, width)
            held, rows = [], 0
        held.append(arrays)
        rows += len(arrays[0])
    if held:
        yield _stacked(held, width)


def _stacked(blocks: list[list[np.ndarray]], width: int) -> tuple:
    labels, sizes, places, values, columns = ([*x] for x in zip(*blocks, strict=True))
    alone = len(blocks) == 1
    place = places[0] if alone else np.concatenate([c[p] for c, p in zip(columns, places, strict=True)])
    size, n = np.concatenate(sizes), sum(map(len, labels))
    x = np.zeros((n, len(columns[0]) if alone else width))
    x[np.repeat(np.arange(n), size), place] = np.concatenate(values)
    share = np.concatenate([np.full(len(y), 1 / len(y)) for y in labels])
    return np.concatenate(labels), share, x, columns[0] if alone else slice(0, width)


def _add(labels: np.ndarray, share: np.ndarray, x: np.ndarray, columns: np.ndarray | slice, weights: list, gradient: list) -> float:
    """Adds the gradient of the rows' losses times their shares to ``gradient`` and returns their sum."""
    rows = np.arange(len(labels))
    outputs, own = [x], [(weights[0][0][columns], weights[0][1]), *weights[1:]]
    for k, (w, b) in enumerate(own, 1):
        z = outputs[-1] @ w + b
        if k == len(own):
            outputs.append(softmax(z.T).T)
        else:
            with np.errstate(over="ignore"):
                outputs.append(1 / (1 + np.exp(-z)))
    delta = outputs.pop()
    with np.errstate(divide="ignore"):
        loss = -float(share @ np.log(delta[rows, labels]))
    delta[rows, labels] -= 1
    delta *= share[:, None]
    for k in range(len(own) - 1, -1, -1):
        inputs, (w, b) = outputs[k], gradient[k]
        b += delta.sum(axis=0)
        if k:
            w += inputs.T @ delta
            delta = (delta @ own[k][0].T) * inputs * (1 - inputs)
        else:
            w[columns] += inputs.T @ delta
    return loss


def loss_and_gradient(blocks: DataFrame, weights: Weights, layers: list[int], n_blocks: int) -> tuple[float, Weights]:
    """The mean of the blocks' mean losses and its gradient, in one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(len(shared.value) + 1)
        own, gradient = _layers(shared.value, layers), _layers(total, layers)
        for stack in _stacks(batch, layers[0]):
            total[-1] += _add(*stack, own, gradient)
        return total

    try:
        total = _pass(blocks, part, len(weights) + 1) / n_blocks
    finally:
        shared.destroy()  # every pass has weights of its own: the driver must not keep them
    return float(total[-1]), total[:-1]


# Optimiser -------------------------------------------------------------------------------------------


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through two steps with their values and slopes is least, not too near either."""
    (t0, f0, d0), (t1, f1, d1) = sorted([left[:3], right[:3]])
    a = d0 + d1 - 3 * (f0 - f1) / (t0 - t1)
    root = np.sqrt(max(a * a - d0 * d1, 0.0))
    low, high = t0 + 0.1 * (t1 - t0), t0 + 0.9 * (t1 - t0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = t1 - (t1 - t0) * np.float64(d1 + root - a) / (d1 - d0 + 2 * root)
    return float(np.clip(t, low, high)) if np.isfinite(t) else (t0 + t1) / 2


def line_search(at: Callable[[float], tuple], start: tuple, t: float) -> tuple:
    """A step that meets the strong Wolfe conditions (Nocedal and Wright, 3.5); ``at`` gives step, value, slope, ..."""
    _, value, slope, *_ = start
    if not slope <= 0:
        raise SearchFailed("not a direction of descent")
    low, high = start, None
    for i in range(SEARCH):
        now = at(t)
        if not np.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > value + ENOUGH * t * slope or (now[1] >= low[1] and i):
            high = now
            break
        if abs(now[2]) <= FLATTER * abs(slope):
            return now
        if now[2] >= 0:
            low, high = now, low
            break
        low = now
        t *= 1.5
    if high is None:
        raise SearchFailed("no interval")
    for _ in range(SEARCH):
        now = at(_between(low, high))
        if not now[1] <= value + ENOUGH * now[0] * slope or now[1] >= low[1]:
            high = now
            continue
        if abs(now[2]) <= FLATTER * abs(slope):
            return now
        if now[2] * (high[0] - low[0]) >= 0:
            high = low
        low = now
    raise SearchFailed("no step in the interval")


def _direction(gradient: Weights, steps: list[Weights], changes: list[Weights]) -> Weights:
    """Minus the gradient times the inverse Hessian that the latest steps and changes of the gradient suggest."""
    found = gradient.copy()
    kept = []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ found) / (s @ y)
        found -= a * y
        kept.append(a)
    if steps:
        found *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(kept)):
        found += (a - (y @ found) / (s @ y)) * s
    return -found


def minimise(evaluate: Callable[[Weights], tuple[float, Weights]], start: Weights, max_iter: int, tolerance: float) -> Weights:
    """L-BFGS with the stopping rules of Spark's.

    It ends after ``max_iter`` steps, when the latest values differ by ``tolerance`` of the first, when the gradient is
    flat, or when a line search fails twice in a row, the second time down the gradient.
    """
    x, (value, gradient) = start, evaluate(start)
    first, values, steps, changes, failed, n = value, [], [], [], False, 0
    while n < max_iter:
        if len(values) == LATEST and abs(value - max(values)) <= tolerance * first:
            break
        if np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        towards = _direction(gradient, steps, changes)

        def at(t: float) -> tuple:
            there = x + t * towards
            its_value, its_gradient = evaluate(there)
            return t, its_value, float(its_gradient @ towards), there, its_gradient

        try:
            begin = (0.0, value, float(gradient @ towards), x, gradient)
            t, now, _, there, its_gradient = line_search(at, begin, 1.0 if n else 1.0 / np.linalg.norm(towards))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed("the step is too small")
        except SearchFailed as reason:
            if failed:
                warnings.warn(f"perceptron: ended after {n} steps: {reason}", stacklevel=2)
                break
            failed, steps, changes = True, [], []
            continue
        steps, changes = [*steps, there - x][-MEMORY:], [*changes, its_gradient - gradient][-MEMORY:]
        x, value, gradient, failed, n = there, now, its_gradient, False, n + 1
        values = [*values, value][-LATEST:]
    return x


# Fit -------------------------------------------------------------------------------------------------


def perceptron(train: DataFrame, hidden: tuple[int, ...] = (100,), **params) -> C.MultilayerPerceptronClassificationModel:
    """Feed-forward network; input and output widths come from the data, ``params`` are those of Spark's classifier.

    The model is Spark's without a training summary. Rows without features or label are an error. Only ``solver="gd"``
    is left to Spark's own fit, which keeps dense rows.
    """
    features, label = params.get("featuresCol", "features"), params.get("labelCol", "label")
    width = len(train.select(features).first()[0])
    classes = int(train.agg(F.max(label)).first()[0]) + 1
    spark_fit = C.MultilayerPerceptronClassifier(**{"layers": [width, *hidden, classes], "seed": 42, "maxIter": 200, **params})
    if spark_fit.getSolver() != "l-bfgs":
        return spark_fit.fit(train)
    ship_package(train.sparkSession)
    layers, row = spark_fit.getLayers(), train.limit(1)
    start = spark_fit.fit(row, {spark_fit.maxIter: 0}).weights.toArray()
    blocks = pack(train, width, classes, spark_fit.getBlockSize(), features, label).persist(StorageLevel.DISK_ONLY)
    try:
        n_blocks = blocks.count()
        cores = train.sparkSession.sparkContext.defaultParallelism
        parts = blocks.coalesce(cores) if blocks.rdd.getNumPartitions() > cores else blocks  # each sends its sums a pass

        def evaluate(weights: Weights) -> tuple[float, Weights]:
            return loss_and_gradient(parts, weights, layers, n_blocks)

        found = minimise(evaluate, start, spark_fit.getMaxIter(), spark_fit.getTol())
    finally:
        blocks.unpersist()
    model = spark_fit.fit(row, {spark_fit.maxIter: 0, spark_fit.initialWeights: Vectors.dense(found)})
    return model.copy({model.maxIter: spark_fit.getMaxIter()})
