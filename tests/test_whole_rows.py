"""No operator may lose, cap or mix rows: nulls, ties, long numbers, blank texts."""

import pytest
from pyspark.sql import functions as F

from forumloom.operators import tokens
from forumloom.operators import clean, features, series, split, threads


def test_top_per_forum_takes_the_limit_as_given(spark):
    posts = spark.range(1500).select(F.lit("a").alias("subreddit"), F.col("id").alias("post_id"), F.col("id").alias("top"))
    assert clean.top_per_forum(posts, "top", 1200).count() == 1200
    assert clean.top_per_forum(posts, "top", None).count() == 1500
    assert clean.top_per_forum(posts, "top", 0).count() == 0


def test_histogram_of_a_constant_and_of_nan(spark):
    same = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert [r.n for r in series.histogram(same, "v", bins=2).orderBy("bin").collect()] == [3, 0]
    odd = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "v double")
    rows = series.histogram(odd, "v", bins=2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.n) for r in rows] == [(0.0, 0.5, 1), (0.5, 1.0, 1)]
    assert series.histogram(odd.limit(0), "v").count() == 0


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), (None, 2, 4.0)], "k string, t int, v double")
    found = {(r.k, r.t): r.rolling for r in series.rolling_mean(rows, "k", ["t"], "v", 2).collect()}
    assert found == {("a", 1): None, (None, 1): None, (None, 2): 3.0}
    posts = spark.createDataFrame([(None, "p1"), (None, "p2"), ("f", "p3")], "subreddit string, post_id string")
    counters = {r.post_id: r.post_counter for r in threads.number_posts(posts).collect()}
    assert counters == {"p1": "1/2", "p2": "2/2", "p3": "1/1"}


def test_stratified_split_gives_a_null_class_its_test_rows(spark):
    rows = spark.range(100).select(
        F.col("id").cast("string").alias("comment_id"), F.when(F.col("id") < 60, F.lit("x")).alias("label")
    )
    found = split.stratified_split(rows, "label", test_size=0.25).where("split = 'test'")
    assert {r.label: r["count"] for r in found.groupBy("label").count().collect()} == {"x": 15, None: 10}


def test_threads_keep_long_sibling_numbers_apart(spark):
    rows = [("p", "a", None, 1700000000002), ("p", "b", None, 1700000000001), ("p", "b1", "b", 5), ("p", "b0", "b", 5)]
    replies = spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, sibling long")
    flat = threads.flatten_threads(replies).orderBy("path").collect()
    assert [r.comment_id for r in flat][0] == "b" and [r.comment_id for r in flat][-1] == "a"


def test_threads_report_cycles(spark):
    rows = [("p", "a", "b", 1), ("p", "b", "a", 1), ("p", "c", None, 2)]
    replies = spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, sibling long")
    with pytest.raises(ValueError, match="cycle"):
        threads.flatten_threads(replies)


def test_documents_without_tokens_keep_a_vector(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "  "), ("3", "zzz")], "comment_id string, text string")
    known = spark.createDataFrame([("a", [1.0, 3.0])], "token string, vector array<float>")
    found = {r.comment_id: list(r.vector) for r in features.document_vectors(docs, known).collect()}
    assert found == {"1": [0.5, 1.5], "2": [0.0, 0.0], "3": [0.0, 0.0]}
    cells = spark.createDataFrame([("1", 2, 1.0)], "comment_id string, term_idx long, value double")
    sparse = {r.comment_id: r.features for r in features.sparse_vectors(cells, 4, ids=docs).collect()}
    assert sorted(sparse) == ["1", "2", "3"] and sparse["2"].numNonzeros() == 0 and sparse["1"][2] == 1.0


def test_stop_words_and_mapping_keep_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame(
        [("1", "A b"), ("1", "c  d the"), ("2", "the"), ("3", ""), ("4", None)], "comment_id string, text string"
    )
    words = spark.createDataFrame([("the",), ("a",), (None,)], "word string")
    want = [("1", "b"), ("1", "c d"), ("2", ""), ("3", ""), ("4", None)]
    rows = lambda df: sorted(map(tuple, df.select("comment_id", "text").collect()), key=str)
    assert rows(tokens.remove_stop_words(docs, words)) == want
    monkeypatch.setattr(tokens, "MAX_WORD_LIST", 0)
    assert rows(tokens.remove_stop_words(docs, words)) == want
    mapping = spark.createDataFrame([("b", "B"), ("the", "x y")], "token string, lemma string")
    mapped = tokens.map_tokens(docs, mapping)
    assert rows(mapped) == [("1", "A B"), ("1", "c d x y"), ("2", "x y"), ("3", ""), ("4", None)]
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2
