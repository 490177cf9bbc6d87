"""Hashed cells become vectors inside their rows, and solvers get a partition per core at most."""

import pytest
from pyspark.sql import functions as F

from forumloom.operators import columns, features, models
from workload import learning_queries as queries

DOCS = [("1", "b a bb aa bb cc"), ("2", ""), ("3", None), ("4", "aa éé dd"), ("5", "zz zz aa"), ("6", "only here")]


@pytest.mark.parametrize("most", [1 << 21, 2])
def test_vectors_equal_those_of_joined_cells(spark, monkeypatch, most):
    monkeypatch.setattr(columns, "MAX_COLUMNS", most)
    docs = spark.createDataFrame(DOCS, "comment_id string, text string")
    cells = features.hashed_vectors(docs, 1 << 10)
    bags = features.hashed_bags(docs.withColumn("other", F.length("comment_id")), 1 << 10)
    assert bags.columns == ["comment_id", "other", "cells"]
    occurring = columns.fit_columns(cells.where("comment_id <> '6'"))
    wanted = {r.comment_id: r.features for r in columns.compact_vectors(cells, occurring, docs).collect()}
    found = {r.comment_id: r.features for r in columns.vectors_in_rows(bags, occurring).collect()}
    assert found == wanted and len(found) == len(DOCS)


def test_labelled_rows_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, f"word{i} aa bb", "abc"[i % 3], i) for i in range(12)] + [(3, "cc dd", "a", 1), (None, "ee", "b", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries._labelled(spark, str(tmp_path), norm=None).collect()
    ids = [r.comment_id for r in found]
    assert len(ids) == 15 and ids.count("3") == 4  # each of the two rows meets the cells of both
    assert {r.features.numNonzeros() for r in found if r.comment_id == "3" and r.split == "train"} <= {5}


def test_solvers_get_a_partition_per_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert models.few_parts(spark.range(100).repartition(5 * cores)).rdd.getNumPartitions() == cores
    assert models.few_parts(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1


def test_linear_fits_pass_their_partitions_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "few_parts", lambda train: seen.append(1) or train)
    rows = spark.createDataFrame([(float(i % 2), float(i)) for i in range(12)], "label double, x double")
    rows = rows.select("label", F.expr("array(x, 1.0 + label)").alias("v"))
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("label", array_to_vector("v").alias("features")).cache()
    for name, regression, params in [("logistic_regression", False, {}), ("sgd", False, {"maxIter": 2}), ("linear_svm", False, {"maxIter": 2}),
                                     ("sgd", False, {"loss": "log_loss", "maxIter": 2}), ("ridge", True, {}), ("huber", True, {"maxIter": 2})]:
        models.fit(name, rows, regression, **params)
    assert len(seen) == 6
