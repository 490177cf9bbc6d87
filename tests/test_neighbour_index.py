"""The metric index gives the rows of brute force and visits only what the bounds leave open."""

import numpy as np
import pytest

from forumloom.operators import neighbours


def brute(queries, train, k):
    found = {}
    for i, v in queries:
        order = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w, _ in train)[:k]
        found[i] = [j for _, j in order]
    return found


def searched(spark, queries, train, **options):
    q = spark.createDataFrame(queries, "vec_id long, embedding array<double>")
    t = spark.createDataFrame(train, "vec_id long, embedding array<double>, label long")
    near, visited = neighbours.search(neighbours.fit_index(t, "label", **options), q)
    got = {}
    for r in near.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    return got, visited.collect()


def clusters(n, groups, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, 4)) * 20
    return [[float(x) for x in centres[i % groups] + draw.normal(size=4) * spread] for i in range(n)]


def test_a_third_of_the_points_equal(spark):
    points = clusters(400, 8, 0.5, 3)
    train = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else p, i % 5) for i, p in enumerate(points)]
    queries = [(1000 + i, p) for i, p in enumerate(clusters(40, 8, 0.6, 3))] + [(2000, [1.0, 2.0, 3.0, 4.0]), (2001, [1.0, 2.0, 3.0, 4.5])]
    got, _ = searched(spark, queries, train, block_rows=20)
    assert got == brute(queries, train, 5)
    assert got[2000] == [0, 3, 6, 9, 12]


def test_rings_that_bounds_exclude_are_not_visited(spark):
    train = [(i, p, 0) for i, p in enumerate(clusters(900, 9, 0.2, 5))]
    queries = [(5000 + i, p) for i, p in enumerate(clusters(45, 9, 0.2, 5))]
    q = spark.createDataFrame(queries, "vec_id long, embedding array<double>")
    t = spark.createDataFrame(train, "vec_id long, embedding array<double>, label long")
    index = neighbours.fit_index(t, "label", block_rows=50)
    near, visited = neighbours.search(index, q)
    got = {}
    for r in near.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    assert got == brute(queries, train, 5)
    assert visited.count() == visited.distinct().count()
    assert visited.count() < 0.35 * len(queries) * index.rings.count()


@pytest.mark.parametrize("pivots", [1, 3])
def test_few_pivots_make_rings_and_blocks(spark, pivots):
    line = [(i, [float(min(i, 150)), 0.0], i % 2) for i in range(240)]  # the rest ties at one place, within k copies
    circle = [(1000 + i, [200 * float(np.cos(i)), 200 * float(np.sin(i))], 1) for i in range(200)]
    queries = [(9000, [10.2, 0.0]), (9001, [150.0, 0.0]), (9002, [0.0, 0.0]), (9003, [-500.0, 3.0])]
    train = line + circle
    got, visited = searched(spark, queries, train, k=7, block_rows=16, pivots=pivots)
    assert got == brute(queries, train, 7)
    assert max(r.ring for r in visited) > 0


def test_fewer_rows_than_neighbours_nulls_and_an_empty_table(spark):
    train = [(1, [0.0, 1.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [2.0, 1.0], 1), (5, [None, 1.0], 1)]
    queries = [(7, [0.0, 0.0]), (8, None), (9, [float("inf"), 0.0])]
    got, _ = searched(spark, queries, train, k=4)
    assert got == {7: [1, 4]}
    assert searched(spark, queries, [], k=4) == ({}, [])
    assert searched(spark, [], train, k=4) == ({}, [])
