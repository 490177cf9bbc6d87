"""Trees grown over blocks of columns: no sums are shuffled, and what a bound leaves out could not have won."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from forumloom.operators import trees


def frame(spark, n=150, columns=40, seed=3):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, columns)), 1) * (draw.random((n, columns)) < draw.random(columns) ** 2)
    y = ((x[:, 0] + x[:, 1] > 0.3).astype(int) + (x[:, 2] < 0)).astype(float)
    rows = [(i, Vectors.sparse(1 << 20, [(9 * c + 1, float(v)) for c, v in enumerate(r) if v]), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["i", "features", "label"]).repartition(3).persist()


FITS = {
    "boosted": lambda df: trees.boosted_classifier(df, rounds=3, max_depth=2, max_bins=64),
    "boosted_regression": lambda df: trees.boosted_regression(df, rounds=3, max_depth=3, max_bins=64),
    "forest": lambda df: trees.forest_classifier(df, n_trees=6, max_depth=3, max_bins=64, share=0.5),
    "forest_regression": lambda df: trees.forest_regression(df, n_trees=6, max_depth=3, max_bins=64),
    "ada_boost": lambda df: trees.ada_boost(df, rounds=4, max_bins=64),
}


@pytest.mark.parametrize("name", FITS)
def test_no_sums_are_shuffled(spark, monkeypatch, name):
    df = frame(spark)
    with monkeypatch.context() as rows_apart:
        rows_apart.setattr(trees, "ROWS_HELD", 0, raising=False)
        want = FITS[name](df)

    def shuffled(*args, **kwargs):
        raise AssertionError("a level shuffles its sums")

    monkeypatch.setattr(trees, "grow", shuffled)
    found = FITS[name](df)
    assert (found.trees.column == want.trees.column).all() and np.allclose(found.trees.at, want.trees.at)
    assert np.allclose(found.values, want.values)


def test_trees_grow_in_lots(spark, monkeypatch):
    df = frame(spark)
    together = trees.forest_regression(df, n_trees=5, max_depth=3)
    monkeypatch.setattr(trees, "NODES_SENT", 300, raising=False)
    lots = trees.forest_regression(df, n_trees=5, max_depth=3)
    assert (together.trees.column == lots.trees.column).all() and np.allclose(together.values, lots.values)


def plain(level, block):
    """The best split of each node, every column summed up on its own."""
    best = []
    for k in range(len(level.nodes)):
        here, found = level.place == k, (-1.0, 0, 0)
        w, v = level.weight * here, level.value
        sides = (lambda s: np.bincount(v[s], w[s], level.n_labels)) if level.gini else (lambda s: np.array([w[s].sum(), (w * v)[s].sum()]))
        score = (lambda s: (s * s).sum() / s.sum()) if level.gini else (lambda s: s[1] ** 2 / s[0])
        rows = lambda s: s.sum() if level.gini else s[0]
        for c in block.column:
            own = block.codes[block.codes // trees.SPAN == c] % trees.SPAN - trees.MIDDLE
            for last in sorted({*own.tolist(), 0}):
                right = block.right(int(c), int(last), len(here))
                a, b = sides(~right), sides(right)
                if min(rows(a), rows(b)) >= level.min_rows:
                    gain = round((score(a) + score(b) - score(a + b)) / rows(a + b), 10)
                    if gain > 0:
                        found = max(found, (gain, -int(c), -int(last)))
        best.append(found)
    return best


@pytest.mark.parametrize("gini", [False, True])
@pytest.mark.parametrize("drawn", [False, True])
def test_columns_left_out_cannot_win(monkeypatch, gini, drawn):
    monkeypatch.setattr(trees, "LEADERS", 2, raising=False)
    monkeypatch.setattr(trees, "BINS_AT_ONCE", 50)
    draw = np.random.default_rng(5)
    n, summed = 80, []
    for turn in range(6):
        cells = [(c, int(b), r) for c in range(60) for r in np.flatnonzero(draw.random(n) < 0.3 * draw.random()) for b in [draw.integers(-2, 3)]]
        code, at = (np.array(x) for x in zip(*sorted((c * trees.SPAN + b + trees.MIDDLE, r) for c, b, r in cells), strict=True))
        codes, starts = np.unique(code, return_index=True)
        block = trees.Columns(codes, np.append(starts, len(code)), at, np.unique(codes // trees.SPAN, return_index=True)[1])
        node, weight = draw.integers(0, 1 + turn % 3, n) + (turn > 2), np.ones(n) if not drawn else draw.integers(0, 3, n).astype(float)
        strong = np.isin(np.arange(n), at[(code // trees.SPAN == 7) & (code % trees.SPAN > trees.MIDDLE)])
        value = strong.astype(int) + 2 * (draw.random(n) < 0.1) if gini else 3 * strong + draw.normal(size=n)
        level = trees.Level(node, np.unique(node), weight, value, 4 if gini else 1, gini, 1.0)
        lot = trees.Level._lot

        def counted(self, block, some, tried, lot=lot):
            summed.append(len(some))
            lot(self, block, some, tried)

        monkeypatch.setattr(trees.Level, "_lot", counted)
        level.search(block, None)
        monkeypatch.setattr(trees.Level, "_lot", lot)
        got = [(x.gain, -x.column, -x.bin) if x.block else (-1.0, 0, 0) for x in level.found]
        assert np.allclose(np.array(got), np.array(plain(level, block)), atol=1e-9)
    assert sum(summed) < 6 * 60  # some columns were left out


@pytest.mark.parametrize("held", [0, 1 << 24])
def test_leaves_hold_the_rows_that_reach_them(spark, monkeypatch, held):
    """With few bins a column's small values share the bin of zero, and go to the side of the rows without the column."""
    monkeypatch.setattr(trees, "ROWS_HELD", held, raising=False)
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(120, 4)), 3) * (draw.random((120, 4)) < 0.8)
    y = 3.0 * (x[:, 0] > 0.0) + (np.abs(x[:, 1]) < 0.1) + x[:, 2]
    rows = [(Vectors.dense(v), float(t)) for v, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, ["features", "label"])
    found = trees.tree_regression(df, max_depth=4, max_bins=4).transform(df).select("label", "prediction").collect()
    leaves = {}
    for label, prediction in found:
        leaves.setdefault(round(prediction, 9), []).append(label)
    assert len(leaves) > 4 and all(abs(np.mean(own) - mean) < 1e-6 for mean, own in leaves.items())
