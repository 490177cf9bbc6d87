"""Histogram trees over sparse columns against dense trees grown by brute force."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from forumloom.operators import trees

WIDTH = 1 << 20


def data(seed=1, n=60, columns=7, classes=3):
    generator = np.random.default_rng(seed)
    x = generator.integers(-2, 4, size=(n, columns)) * (generator.random((n, columns)) < 0.5) / 2.0
    x[:, 5] = 0.0  # a column that never occurs
    y = (np.abs(x[:, 0] * 2 + x[:, 1] + x[:, 2]).round().astype(int) + (generator.random(n) < 0.1)) % classes
    return x, y.astype(float)


def frame(spark, x, y, width=WIDTH):
    """Column c of the small case is column 1009 * c + 3 of the wide one."""
    rows = [(i, Vectors.sparse(width, [(1009 * int(c) + 3, float(v)) for c, v in enumerate(r) if v]), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["i", "features", "label"]).repartition(3)


def gini(y, w, classes):
    s = np.bincount(y.astype(int), w, classes)
    return (s * s).sum() / s.sum()


def variance(y, w, classes):
    return (w * y).sum() ** 2 / w.sum()


def dense_tree(x, y, depth, score, classes=3, w=None, cuts=None):
    """Splits as nested tuples (column, cut, left, right) and the row sets of leaves."""
    w = np.ones(len(y)) if w is None else w
    cuts = cuts or [np.unique(np.append(x[:, c], 0.0)) for c in range(x.shape[1])]

    def grow(rows, level):
        best = None
        if level < depth:
            for c in range(x.shape[1]):
                for a, b in zip(cuts[c][:-1], cuts[c][1:], strict=True):
                    left = rows[x[rows, c] <= (a + b) / 2]
                    right = np.setdiff1d(rows, left)
                    if len(left) and len(right):
                        gain = score(y[left], w[left], classes) + score(y[right], w[right], classes) - score(y[rows], w[rows], classes)
                        gain = round(gain / w[rows].sum(), 10)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, c, (a + b) / 2, left, right)
        if best is None:
            return rows
        return best[1], best[2], grow(best[3], level + 1), grow(best[4], level + 1)

    return grow(np.arange(len(y)), 0)


def dense_predict(tree, x, leaf):
    if isinstance(tree, np.ndarray):
        return np.full(len(x), leaf(tree))
    c, cut, left, right = tree
    return np.where(x[:, c] <= cut, dense_predict(left, x, leaf), dense_predict(right, x, leaf))


def splits(tree):
    return [] if isinstance(tree, np.ndarray) else [(1009 * tree[0] + 3, tree[1]), *splits(tree[2]), *splits(tree[3])]


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("i").collect()])


@pytest.mark.parametrize("parts", [1, 3])
def test_tree_splits_equal_a_dense_tree(spark, monkeypatch, parts):
    x, y = data()
    monkeypatch.setattr(trees, "CELLS_PER_TASK", 1 << 20 if parts == 1 else 60)
    df = frame(spark, x, y)
    model = trees.tree_classifier(df, max_depth=4)
    want = dense_tree(x, y, 4, gini)
    found = {(int(c), float(a)) for c, a in zip(model.trees.column[0], model.trees.at[0], strict=True) if c >= 0}
    assert found == set(splits(want))
    expected = dense_predict(want, x, lambda rows: np.bincount(y[rows].astype(int), minlength=3).argmax())
    assert (predictions(model, df) == expected).all()
    shares = model.transform(df).select("probability").first()[0]
    assert abs(sum(shares) - 1) < 1e-9


def test_regression_tree_equals_a_dense_tree(spark):
    x, _ = data(2)
    y = x[:, 0] * 3 - x[:, 3] ** 2 + x[:, 4]
    df = frame(spark, x, y)
    want = dense_tree(x, y, 3, variance)
    expected = dense_predict(want, x, lambda rows: y[rows].mean())
    assert np.allclose(predictions(trees.tree_regression(df, max_depth=3), df), expected)


@pytest.mark.parametrize("refresh", [50, 2])
def test_boosting_equals_dense_boosting(spark, refresh):
    x, y = data(3)
    df, rounds, rate = frame(spark, x, y), 5, 0.3
    score = np.repeat(np.log(np.bincount(y.astype(int), minlength=3) / len(y))[:, None], len(y), axis=1)
    for _ in range(rounds):
        chance = trees.softmax(score)
        for k in range(3):
            r = (y == k) - chance[k]
            size = np.abs(r) * (1 - np.abs(r))
            tree = dense_tree(x, r, 2, variance)
            score[k] += rate * dense_predict(tree, x, lambda rows, r=r, size=size: 2 / 3 * r[rows].sum() / size[rows].sum())
    model = trees.boosted_classifier(df, rounds=rounds, max_depth=2, learning_rate=rate, refresh=refresh)
    found = np.array([r.probability.toArray() for r in model.transform(df).orderBy("i").collect()])
    assert np.allclose(found, trees.softmax(score).T, atol=1e-7)


def test_boosted_regression_equals_dense_boosting(spark):
    x, _ = data(4)
    y = x[:, 0] * 3 - x[:, 3] ** 2
    score = np.full(len(y), y.mean())
    for _ in range(4):
        tree = dense_tree(x, y - score, 2, variance)
        score = score + 0.5 * dense_predict(tree, x, lambda rows, r=y - score: r[rows].mean())
    df = frame(spark, x, y)
    assert np.allclose(predictions(trees.boosted_regression(df, rounds=4, max_depth=2, learning_rate=0.5), df), score)


def test_ada_boost_equals_reweighting(spark):
    x, y = data(5)
    w, votes = np.full(len(y), 1 / len(y)), np.zeros((len(y), 3))
    for _ in range(4):
        tree = dense_tree(x, y, 1, gini, w=w)
        chosen = dense_predict(tree, x, lambda rows, w=w: np.bincount(y[rows].astype(int), w[rows], 3).argmax())
        error = w[chosen != y].sum() / w.sum()
        amount = np.log((1 - error) / error) + np.log(2)
        votes[np.arange(len(y)), chosen.astype(int)] += amount
        w = w * np.exp(amount * (chosen != y))
        w /= w.sum()
    df = frame(spark, x, y)
    assert (predictions(trees.ada_boost(df, rounds=4), df) == votes.argmax(axis=1)).all()


def test_one_pass_per_level_serves_all_classes(spark, monkeypatch):
    """A round of three trees of two levels is two jobs over the rows, whatever the classes."""
    x, y = data(6)
    df, calls = frame(spark, x, y), []
    summed = trees.Growth.__init__

    def counted(self, *args, **kwargs):
        calls.append(args[0].column.shape[0])
        summed(self, *args, **kwargs)

    monkeypatch.setattr(trees.Growth, "__init__", counted)
    trees.boosted_classifier(df, rounds=2, max_depth=2)
    assert calls == [3, 3, 3, 3]


def test_forest_is_better_than_the_majority_and_reproducible(spark):
    x, y = data(7, n=200)
    df = frame(spark, x, y)
    one, two = (predictions(trees.forest_classifier(df, n_trees=20, share=0.7), df) for _ in range(2))
    assert (one == two).all() and (one == y).mean() > np.bincount(y.astype(int)).max() / len(y) + 0.1
    z = x[:, 0] * 2
    found = predictions(trees.forest_regression(frame(spark, x, z), n_trees=20, share=0.9), frame(spark, x, z))
    assert ((found - z) ** 2).mean() < 0.3 * z.var()


def test_dense_vectors_empty_rows_and_one_class(spark):
    rows = [(0, Vectors.dense([0.0, 1.0]), 0.0), (1, Vectors.sparse(2, [], []), 0.0), (2, Vectors.dense([2.0, 0.0]), 0.0)]
    df = spark.createDataFrame(rows, ["i", "features", "label"])
    assert predictions(trees.tree_classifier(df), df).tolist() == [0, 0, 0]
    mixed = df.withColumn("label", (F.col("i") == 2).cast("double"))
    assert predictions(trees.tree_classifier(mixed), mixed).tolist() == [0, 0, 1]
    assert predictions(trees.boosted_regression(mixed, rounds=3, learning_rate=1.0), mixed).tolist() == [0, 0, 1]


def test_many_values_are_cut_at_quantiles(spark):
    n = 4000
    df = spark.range(n).select(F.lit(3).alias("column"), ((F.col("id") - n / 4) / 7).alias("value"))
    cuts = np.array(trees.fit_cuts(df, 16).first()["cuts"])
    assert 14 <= len(cuts) <= 17 and (np.diff(cuts) > 0).all() and (cuts < 0).sum() in range(3, 6)


def test_blocks_use_every_core_and_hold_exact_bins(spark):
    """A small input is a block per core, its bins counted from the boundaries that the same pass found."""
    x, y = data(8, n=200)
    blocks, cuts, width = trees._binned(frame(spark, x, y).withColumn("label", F.col("i").cast("double")), "label", 4)
    assert blocks.count() >= spark.sparkContext.defaultParallelism and width == WIDTH
    of = {r.column: np.array(r.cuts) for r in cuts.collect()}
    found = set()
    for batch in blocks.toArrow().to_batches():
        for i in range(batch.num_rows):
            block, _, label, _ = trees.read_block(batch, i, width)
            column, bins = np.divmod(block.codes[block.code], trees.SPAN)
            found |= {(int(label[a]), int(c), int(b) - trees.MIDDLE) for a, c, b in zip(block.at, column, bins, strict=True)}
    cells = ((i, 1009 * c + 3, v) for i, r in enumerate(x) for c, v in enumerate(r) if v)
    assert found == {(i, c, int((of[c] < v).sum()) - int((of[c] < 0).sum())) for i, c, v in cells}
