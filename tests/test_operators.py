import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from forumloom.operators import clean, models, neighbours, order, series, skew, split, threads
from forumloom.sources import readers, writers


def test_hot_key_join_keeps_every_row(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = skew.join_lookup(big, lookup, ["k"])
    assert out.count() == 3000
    assert out.where("v != k * 2").count() == 0


def test_positions_and_group_positions(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), "id")
    assert [r.position for r in order.with_positions(df, ["id"]).orderBy("id").collect()] == list(range(1000))
    placed = order.with_group_positions(df, ["g"], ["id"]).where("g = 'hot'").orderBy("id").collect()
    assert [r.position for r in placed] == list(range(400))


def test_deep_chain_and_wide_star(spark):
    chain = [("p", str(i), str(i - 1) if i else None, 0) for i in range(300)]
    star = [("q", "root", None, 0)] + [("q", f"c{i}", "root", i) for i in range(300)] + [("q", "lost", "nobody", 1)]
    df = spark.createDataFrame(chain + star, "post_id string, comment_id string, parent_id string, sibling int")
    flat = threads.flatten_threads(df)
    depths = {r.comment_id: r.depth for r in flat.where("post_id = 'p'").collect()}
    assert depths == {str(i): i for i in range(300)}
    numbered = threads.number_comments(flat.select("post_id", "comment_id", "path")).where("post_id = 'q'")
    rows = {r.comment_id: (r.num_comment, r.num_comments) for r in numbered.collect()}
    assert rows["root"] == (1, 301) and rows["c7"] == (9, 301) and "lost" not in rows


@pytest.mark.parametrize("sizes, expected", [((None, None), (7, 3)), ((0.3, None), (7, 3)), ((2, 5), (5, 2)), ((None, 0.5), (5, 5))])
def test_split_sizes(spark, sizes, expected):
    assert split.split_sizes(10, *sizes) == expected
    df = spark.range(10).select(F.col("id").cast("string").alias("comment_id"))
    got = {r.split: r["count"] for r in split.random_split(df, "comment_id", *sizes).groupBy("split").count().collect()}
    assert (got["train"], got["test"]) == expected


def test_split_refines_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "_DIGITS", 1)
    df = spark.range(5000).select(F.col("id").cast("string").alias("comment_id"))
    assert split.random_split(df, test_size=0.25).where("split = 'test'").count() == 1250


def test_keep_first_and_merge(spark):
    schema = "comment_id string, subreddit string, text string"
    new = spark.createDataFrame([("1", "a", "new"), ("2", "a", "two")], schema)
    old = spark.createDataFrame([("1", "a", "old"), ("3", "b", "three")], schema)
    rows = {(r.comment_id, r.text) for r in clean.merge_comments(new, old).collect()}
    assert rows == {("1", "new"), ("2", "two"), ("3", "three")}


def test_resume_with_nothing_left_is_an_error(spark):
    df = spark.createDataFrame([("1",)], "comment_id string")
    with pytest.raises(ValueError):
        clean.drop_done(df, df, require_rows=True)


def test_parent_folder_and_folder_list_agree(spark, tmp_path):
    rows = [("1", "p", "a", "x", 1), ("2", "q", "b", "y", 2), ("3", "q", "b", "z", 3)]
    df = spark.createDataFrame(rows, "comment_id string, post_id string, subreddit string, text string, upvotes long")
    path = str(tmp_path / "t")
    writers.write_comments(df, path, ("subreddit", "post_id"))
    whole = sorted(readers.read_comments(spark, path).collect())
    listed = sorted(readers.read_comments(spark, [f"{path}/subreddit=a", f"{path}/subreddit=b"]).collect())
    assert whole == listed == sorted(df.collect())
    plan = readers.read_comments(spark, path, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "subreddit" in plan.split("PartitionFilters")[1][:80]


def test_rolling_mean_across_chunks(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), "id", (F.col("id") * F.col("id")).cast("double").alias("v"))
    rows = series.rolling_mean(df, "k", ["id"], "v", 3, chunk=4).orderBy("id").collect()
    assert rows[0].rolling is None and rows[1].rolling is None
    for i in range(2, 50):
        assert math.isclose(rows[i].rolling, (i**2 + (i - 1) ** 2 + (i - 2) ** 2) / 3)


def test_neighbours_equal_brute_force_with_many_copies(spark):
    from forumloom.session import ship_package

    ship_package(spark)
    generator = np.random.default_rng(1)
    points = generator.normal(size=(120, 4)).round(1)
    points[:40] = points[0]  # a third are copies
    rows = [(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    queries, train = df.where("vec_id < 20"), df.where("vec_id >= 20")
    got = neighbours.nearest_neighbours(queries, train, "label", block_rows=30)
    found = {(r["query"], r["rank"]): r["neighbour"] for r in got.collect()}
    for q in range(20):
        ranked = sorted(range(20, 120), key=lambda i: (np.sqrt(((points[q] - points[i]) ** 2).sum()), i))
        assert [found[q, r] for r in range(1, 6)] == ranked[:5]


def test_ridge_equals_the_closed_form(spark):
    generator = np.random.default_rng(2)
    x = generator.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + generator.normal(size=60)
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, label double")
    model = models.ridge(df.select(array_to_vector("x").alias("features"), "label"), alpha=5.0)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 5.0 * np.eye(3), centred.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), expected, atol=1e-6)
