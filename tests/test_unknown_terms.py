"""Documents without a known term are fitted, predicted and scored like all others."""

import math

import pytest

from forumloom.operators import bayes
from forumloom.plans import jobs


def test_bayes_gives_documents_without_known_terms_the_largest_prior(spark):
    cells = "comment_id string, term_idx long, value double"
    train = spark.createDataFrame([("1", 0, 1.0), ("2", 0, 2.0), ("3", 1, 1.0)], cells)
    labels = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "comment_id string, label string")
    test = spark.createDataFrame([("4", 1, 3.0)], cells)
    ids = spark.createDataFrame([("4",), ("5",), ("5",)], "comment_id string")
    model = bayes.fit_bayes(train, labels)
    found = {r.comment_id: r.prediction for r in bayes.predict_bayes(model, test, ids=ids).collect()}
    assert found == {"4": "b", "5": "a"}
    scores = [(r.label, r.score) for r in bayes.bayes_scores(model, test, ids=ids).where("comment_id = '5'").collect()]
    assert sorted(scores) == [("a", pytest.approx(math.log(2 / 3))), ("b", pytest.approx(math.log(1 / 3)))]


def test_train_scores_documents_without_features(spark, tmp_path):
    rows = [("1", 0, 1.0, "train"), ("2", 1, 1.0, "train"), ("4", 0, 1.0, "test")]
    table = spark.createDataFrame(rows, "comment_id string, term_idx long, value double, split string")
    splits = [("1", "train"), ("2", "train"), ("3", "train"), ("4", "test"), ("5", "test")]
    ids = spark.createDataFrame(splits, "comment_id string, split string")
    names = [("1", "a"), ("2", "b"), ("3", "b"), ("4", "a"), ("5", "a")]
    labels = spark.createDataFrame(names, "comment_id string, subreddit string")
    target = str(tmp_path / "out")
    row = jobs.train(table, labels, 2, ids, target=target).first()
    assert row.accuracy_score == 0.5
    found = {r.comment_id: r.y_pred for r in spark.read.parquet(target).collect()}
    assert found == {"4": "a", "5": "b"}
