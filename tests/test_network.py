"""The perceptron over sparse blocks equals Spark's dense fit, without giving Spark's fit the train rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import classification as C
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import types as T

from forumloom.operators import models, network

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])


def table(spark, n=70, width=30, classes=3, parts=3):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(n):
        cells = np.sort(draw.choice(width, draw.integers(0, 6), replace=False))
        vector = SparseVector(width, cells.tolist(), draw.normal(size=len(cells)).tolist())
        rows.append((i, DenseVector(vector.toArray()) if i % 3 == 0 else vector, float(i % classes)))
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), SCHEMA)


def test_sparks_fit_meets_one_row_and_the_result_is_the_same(spark, monkeypatch):
    df = table(spark)
    expected = C.MultilayerPerceptronClassifier(layers=[30, 5, 4, 3], seed=42, maxIter=4, blockSize=16).fit(df)
    met, fit = [], C.MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(C.MultilayerPerceptronClassifier, "_fit", lambda self, rows: met.append(rows.count()) or fit(self, rows))
    model = models.fit("perceptron", df, hidden=(5, 4), maxIter=4, blockSize=16)
    assert np.allclose(model.weights.toArray(), expected.weights.toArray(), atol=1e-9)
    assert model.getMaxIter() == 4 and not model.hasSummary
    judged, known = ({r.id: r.prediction for r in m.transform(df).collect()} for m in (model, expected))
    assert judged == known
    assert max(met) == 1  # all of it is kept dense


@pytest.mark.parametrize("at_once", ["7", "10000"])
def test_blocks_hold_the_cells_of_a_partitions_rows_in_order(spark, at_once):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    try:
        df = table(spark, n=45, width=1 << 16, parts=2)
        blocks = network.pack(df, 1 << 16, 3, 10).collect()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [len(np.frombuffer(b.labels, np.int32)) for b in blocks] == [10, 10, 2, 10, 10, 3]
    seen = []
    for b in blocks:
        columns = np.frombuffer(b.columns, np.int64)[np.frombuffer(b.places, np.int32)]
        ends = np.cumsum(np.frombuffer(b.sizes, np.int32))[:-1]
        seen += [*zip(np.split(columns, ends), np.split(np.frombuffer(b.cells), ends), np.frombuffer(b.labels, np.int32))]
    for row, (columns, values, label) in zip(rows, seen, strict=True):
        dense = row.features.toArray()
        assert columns.tolist() == np.flatnonzero(dense).tolist() and values.tolist() == dense[columns].tolist() and label == row.label
    cells = sum(len(np.frombuffer(b.cells)) for b in blocks)
    assert sum(len(x) for b in blocks for x in b) <= 20 * cells + 8 * 45  # nothing as wide as the features


def _record(vectors, labels):
    kinds = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_arrays([pa.array(vectors, kinds), pa.array(labels, pa.float64())], ["features", "label"])


def _sparse(size, indices):
    return {"type": 0, "size": size, "indices": indices, "values": [1.0] * len(indices)}


def test_rows_that_cannot_be_fitted_are_an_error():
    good = _sparse(4, [1, 3])
    assert len(network._packed(_record([good, _sparse(4, [])], [0.0, 1.0]), 4, 2)) == 1
    for vector, label in [(None, 1.0), (good, 0.5), (good, None), (good, 2.0), (good, -1.0), (_sparse(3, [1]), 0.0), (_sparse(4, [1, 1]), 0.0)]:
        with pytest.raises(ValueError):
            network._packed(_record([good, vector], [0.0, label]), 4, 2)


def test_blocks_made_dense_together_or_alone_add_up_to_the_same(monkeypatch):
    draw, parts = np.random.default_rng(3), []
    for n in (5, 5, 2):
        rows = [_sparse(9, np.sort(draw.choice(9, 3, replace=False)).tolist()) for _ in range(n)]
        parts.append(network._packed(_record(rows, draw.integers(0, 3, n).astype(float)), 9, 3))
    layers, found = [9, 4, 3], []
    weights = draw.normal(size=9 * 4 + 4 + 4 * 3 + 3)
    for dense in (1 << 21, 9 * 10, 1):
        monkeypatch.setattr(network, "DENSE", dense)
        total = np.zeros(len(weights))
        stacks = [*network._stacks(pa.concat_batches(parts), 9)]
        loss = sum(network._add(*s, network._layers(weights, layers), network._layers(total, layers)) for s in stacks)
        found.append((len(stacks), np.append(total, loss)))
    assert [n for n, _ in found] == [1, 2, 3]
    assert all(np.allclose(x, found[0][1], atol=1e-12) for _, x in found)


def test_the_optimiser_ends_where_nothing_falls():
    scale = np.array([1.0, 10.0, 100.0])
    found = network.minimise(lambda x: (float(scale @ (x - 1) ** 2) + 1, 2 * scale * (x - 1)), np.zeros(3), 100, 1e-9)
    assert np.allclose(found, 1, atol=1e-3)
    with pytest.warns(UserWarning, match="ended after 0 steps"):
        network.minimise(lambda x: (float("nan") if x.any() else 1.0, np.ones(2)), np.zeros(2), 5, 1e-6)
