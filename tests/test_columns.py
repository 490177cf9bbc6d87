"""Learners on the columns that occur predict what they predict at full width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumloom.operators import columns, features, models

WIDTH = 3000


@pytest.fixture(scope="module")
def case(spark):
    """Cells over 3000 columns of which about 20 occur in train, some more only in test, and a document without cells."""
    generator = np.random.default_rng(8)
    places = generator.choice(WIDTH, 24, replace=False)
    cells, rows = [], []
    for i in range(90):
        label = i % 3
        own = [*generator.choice(18, 5, replace=False), 18 + label] if i != 7 else []
        own += [21 + i % 3] if i >= 70 else []
        cells += [(str(i), int(places[c]), float(generator.normal() + (3 if c >= 18 else 0))) for c in own]
        rows.append((str(i), float(label), "train" if i < 70 else "test"))
    parts = spark.createDataFrame(rows, "comment_id string, label double, split string")
    table = spark.createDataFrame(cells, "comment_id string, term_idx long, value double").cache()
    occurring = columns.fit_columns(table.join(parts.where("split = 'train'"), "comment_id", "left_semi"))
    wide = parts.join(features.sparse_vectors(table, WIDTH, ids=parts), "comment_id").cache()
    narrow = parts.join(columns.compact_vectors(table, occurring, parts), "comment_id").cache()
    return wide, narrow, occurring, {int(places[c]) for c in range(21)}


def test_columns_are_those_of_train_in_order(case):
    wide, narrow, occurring, places = case
    assert occurring.width == 21 and narrow.first().features.size == 21
    rows = occurring.table.orderBy("column").collect()
    assert [r.term_idx for r in rows] == sorted(places) and [r.column for r in rows] == list(range(21))
    assert narrow.where("comment_id = '7'").first().features.numNonzeros() == 0


CASES = [
    ("logistic_regression", False, {}), ("linear_svm", False, {}), ("sgd", False, {"loss": "log_loss"}), ("ridge", True, {}),
    ("lasso", True, {"alpha": 0.1}), ("huber", True, {}), ("decision_tree", False, {}),
]


@pytest.mark.parametrize("name, regression, params", CASES, ids=lambda x: str(x))
def test_predictions_equal_the_wide_fit(case, name, regression, params):
    wide, narrow, _, _ = case

    def predicted(rows):
        model = models.fit(name, rows.where("split = 'train'"), regression, **params)
        found = models.predict(model, rows).orderBy(F.col("comment_id").cast("int")).select("label", "prediction").collect()
        return np.array([r.label for r in found]), np.array([r.prediction for r in found])

    labels, ours = predicted(narrow)
    _, theirs = predicted(wide)
    assert np.allclose(ours, theirs, atol=1e-3 if regression else 0)
    if not regression:
        assert (ours == labels).mean() > 0.9  # a third are in the largest class
    else:
        assert ((ours - labels) ** 2).mean() < 0.5 * labels.var()


def test_weights_go_back_to_wide_columns(case):
    _, narrow, occurring, places = case
    model = models.fit("ridge", narrow.where("split = 'train'"), regression=True)
    found = {r.term_idx: r.weight for r in columns.column_weights(model.coefficients, occurring).collect()}
    assert set(found) == places and any(abs(w) > 0.01 for w in found.values())


def test_logistic_gradient_vanishes_at_the_fit(case):
    """The penalised loss has no slope at the fitted weights: computed from the rows, not by the library."""
    _, narrow, occurring, _ = case
    train = narrow.where("split = 'train'")
    model = models.logistic_regression(train, maxIter=1000, tol=1e-12)
    rows = train.select("features", "label").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows]).astype(int)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    score = x @ w.T + b
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    slope = (p - np.eye(3)[y]).T @ x / len(y) + w / len(y)
    assert np.abs(slope).max() < 1e-4 and np.abs((p - np.eye(3)[y]).mean(axis=0)).max() < 1e-4


def test_no_train_cells_at_all(spark):
    empty = spark.createDataFrame([], "comment_id string, term_idx long, value double")
    ids = spark.createDataFrame([("1",)], "comment_id string")
    occurring = columns.fit_columns(empty)
    assert occurring.width == 1 and columns.compact_vectors(empty, occurring, ids).first().features.numNonzeros() == 0
