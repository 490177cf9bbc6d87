"""Ridge fits of all classes in shared passes equal the closed form."""

import numpy as np
import pytest
from pyspark import Broadcast, SparkContext
from pyspark.ml.linalg import Vectors
from pyspark.sql import types as T
from pyspark.ml.linalg import VectorUDT

from forumloom.operators import least_squares, models

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])


def table(spark, x, labels, parts=3):
    rows = []
    for i, (v, c) in enumerate(zip(x, labels, strict=True)):
        vector = Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), [(j, float(e)) for j, e in enumerate(v) if e])
        rows.append((i, vector, None if c is None else float(c)))
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def closed_form(x, labels, alpha):
    centred = x - x.mean(axis=0)
    classes = sorted(set(labels))
    y = np.array([[1.0 if c == k else -1.0 for k in classes] for c in labels])
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean(axis=0)))
    return classes, w, y.mean(axis=0) - x.mean(axis=0) @ w


def data(n=90, width=12, classes=5):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(n, width)) * (draw.random((n, width)) < 0.4)
    x[:, 3] = 0.0  # a column that never occurs
    x[: n // 3] = x[0]  # a third of the rows equal
    return x, [int(c) for c in draw.integers(0, classes, n) * 2]


def test_weights_and_predictions_equal_the_closed_form(spark):
    x, labels = data()
    df = table(spark, x, labels)
    model = models.fit("ridge", df, alpha=2.0)
    classes, w, b = closed_form(x, labels, 2.0)
    assert model.classes.tolist() == classes
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.intercepts, b, atol=1e-6)
    expected = {i: classes[k] for i, k in enumerate((x @ w + b).argmax(axis=1))}
    assert {r.id: r.prediction for r in models.predict(model, df).collect()} == expected


def test_classes_share_each_pass_and_groups_change_nothing(spark, monkeypatch):
    x, labels = data()
    df = table(spark, x, labels)
    calls = []
    inner = least_squares.gram_times
    monkeypatch.setattr(least_squares, "gram_times", lambda rows, p: calls.append(p.shape[1]) or inner(rows, p))
    together = least_squares.ridge_classifier(df)
    assert calls[0] == 5 and len(calls) <= x.shape[1] + 3  # as many passes as one target needs
    calls.clear()
    monkeypatch.setattr(least_squares, "BLOCK_BYTES", 8 * 12 * 2)
    apart = least_squares.ridge_classifier(df)
    assert max(calls) == 2 and np.allclose(together.weights, apart.weights, atol=1e-7)


def test_rows_without_label_a_single_class_and_no_rows(spark):
    x, labels = data(30)
    odd = table(spark, np.vstack([x, x[:2] + 50]), [*labels, None, None])
    assert np.allclose(least_squares.ridge_classifier(odd).weights, closed_form(x, labels, 1.0)[1], atol=1e-6)
    single = least_squares.ridge_classifier(table(spark, x, [4] * 30))
    assert np.abs(single.weights).max() < 1e-12 and np.allclose(single.intercepts, [1.0])
    with pytest.raises(ValueError):
        least_squares.ridge_classifier(odd.limit(0))


def test_passes_leave_nothing_on_the_driver(spark, monkeypatch):
    alive = {}
    make, drop = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        made = make(self, value)
        alive[id(made)] = made
        return made

    def destroy(self, *args):
        alive.pop(id(self))
        return drop(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    monkeypatch.setattr(least_squares, "PIECE", 7)  # a sum of many pieces, the last one shorter
    x, labels = data()
    model = least_squares.ridge_classifier(table(spark, x, labels))
    _, w, b = closed_form(x, labels, 1.0)
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.intercepts, b, atol=1e-6)
    assert not alive


def test_products_over_blocks_equal_dense_ones(spark, monkeypatch):
    """Blocks of few rows, among them rows without a cell, a block without one, and labels of another group."""
    monkeypatch.setattr(least_squares, "BLOCK_ROWS", 7)
    x, labels = data()
    x[40:60] = 0.0
    blocks = least_squares.pack(table(spark, x, labels))
    p = np.random.default_rng(2).normal(size=(12, 3))
    assert np.allclose(least_squares.gram_times(blocks, p), x.T @ (x @ p))
    sums, squares = least_squares.column_moments(blocks, 12)
    assert np.allclose(sums, x.sum(axis=0)) and np.allclose(squares, (x * x).sum(axis=0))
    some = np.array([2.0, 6.0])
    expected = np.stack([x[np.array(labels) == c].sum(axis=0) for c in some], axis=1)
    assert np.allclose(least_squares.class_sums(blocks, 12, some), expected)


def test_a_pass_sends_sums_per_core_not_per_partition(spark, monkeypatch):
    x, labels = data()
    seen, inner = [], least_squares._pass
    monkeypatch.setattr(least_squares, "_pass", lambda rows, *args: seen.append(rows.rdd.getNumPartitions()) or inner(rows, *args))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        least_squares.ridge_classifier(table(spark, x, labels, parts=9), max_iter=40)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
