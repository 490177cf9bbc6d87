"""Work units of searches, streams and Bayes scores that grow with the table, not with its square or in one task."""

import os

import numpy as np

from forumloom.operators import bayes, neighbours
from workload import stream_queries


def test_blocks_grow_and_near_homes_share_a_lot(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCKS", 8)
    draw = np.random.default_rng(4)
    points = [(i, [float(x) for x in draw.normal(size=3)], i % 3) for i in range(480)]
    train, queries = spark.createDataFrame(points[:400], "vec_id long, embedding array<double>, label long"), points[400:]
    index = neighbours.fit_index(train, "label", block_rows=4)
    assert index.block_rows == 50 and index.rings.count() < 100
    counts = np.full(len(index.pivots), 3)
    lots = neighbours._lots(index, counts)
    assert max(lots) + 1 == -(-len(counts) // 16) and max(np.bincount(lots)) == 16  # not one per home cell
    near = neighbours.search(index, spark.createDataFrame(queries, "vec_id long, embedding array<double>, label long"))[0]
    got = {}
    for r in near.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    at = np.array([p for _, p, _ in points[:400]])
    for i, p, _ in queries:
        assert got[i] == np.argsort(((at - np.array(p)) ** 2).sum(axis=1), kind="stable")[:5].tolist()


def test_arriving_files_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    path, together = stream_queries._files(spark, "", lambda spark, folder: spark.range(95))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 9 and together == 3
    path, together = stream_queries._files(spark, "", lambda spark, folder: spark.range(12))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3 and together == 1


def test_best_classes_of_stored_scores(spark):
    scores = spark.createDataFrame([("1", "b", -1.0), ("1", "a", -1.0000001), ("2", "b", -1.0), ("2", "a", -2.0)], "comment_id string, lang string, score double")
    found = {r.comment_id: r.prediction for r in bayes.best_classes(scores, "lang", digits=6).collect()}
    assert found == {"1": "a", "2": "b"}
