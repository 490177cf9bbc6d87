"""Exact k nearest neighbours through a metric index: pivots, rings around them, and triangle bounds.

A query first meets the rings of its own cell, which gives it a k-th distance, and then only the rings whose bound
that distance can reach. Work follows the rings visited; on data without structure all of them are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumloom.operators.skew import join_lookup
from forumloom.session import ship_package, stage

_SLICE = 16  # queries measured together; bounds the memory of one step even if all distances tie

PIVOTS = 1024
"""Most pivots of an index; they and one row per cell are all that passes the driver."""

BLOCKS = 32
"""An index has about this many blocks, if that makes them no larger than ``MOST_ROWS``: each is met by every lot of queries."""

MOST_ROWS = 4096

RINGS = 1000
"""Most rings of a cell; a larger cell has rings of more than one block."""

SLACK = 1e-6
"""Share of the vector lengths that bounds give way by, far above the rounding of a distance to a pivot."""


def _block_neighbours(k: int):
    def nearest(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or train.empty:
            return pd.DataFrame({"query": [], "distance": [], "neighbour": [], "target": []})
        q = np.stack(queries["v"].to_numpy()).astype("float64")
        t = np.stack(train["v"].to_numpy()).astype("float64")
        ids = train["neighbour"].to_numpy()
        rank = np.empty(len(ids), dtype="int64")
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        squares = (t * t).sum(axis=1)
        take = min(k, len(t))
        rows, cols, dist = [], [], []
        for start in range(0, len(q), _SLICE):
            part = q[start : start + _SLICE]
            own = (part * part).sum(axis=1)
            rough = own[:, None] + squares[None, :] - 2.0 * part @ t.T
            kth = np.partition(rough, take - 1, axis=1)[:, take - 1]
            # the rough form rounds: keep all within a margin, then measure those exactly
            margin = 1e-10 * (own + squares.max() + 1.0)
            r, c = np.nonzero(rough <= (kth + margin)[:, None])
            exact = np.sqrt(((part[r] - t[c]) ** 2).sum(axis=1))
            order = np.lexsort((rank[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < take
            rows.append(r[keep] + start)
            cols.append(c[keep])
            dist.append(exact[keep])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame(
            {
                "query": queries["query"].to_numpy()[rows],
                "distance": np.concatenate(dist),
                "neighbour": ids[cols],
                "target": train["target"].to_numpy()[cols],
            }
        )

    return nearest


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * v @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # NaN is above infinity in Spark
    )


def _top(rows: DataFrame, keys: list[Column], order: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per key; Spark keeps k per key in each task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


@dataclass(frozen=True)
class NeighbourIndex:
    """``rows``: train rows with ``cell, ring, block``; ``rings``: ``cell, ring, blocks, n, lo, hi``, lo and hi the
    distances from the pivot; ``counts``: rows per cell, in the order of ``pivots``."""

    rows: DataFrame
    rings: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    k: int
    block_rows: int


def fit_index(
    train: DataFrame,
    target: str,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 4096,
    pivots: int = PIVOTS,
) -> NeighbourIndex:
    """An index of train rows for up to ``k`` neighbours.

    Of equal vectors only the ``k`` rows of smallest key can be neighbours, so no more are kept, however many there
    are. Blocks grow with the table, to ``MOST_ROWS`` at most, from ``block_rows``. Pivots are drawn from the distinct vectors by hash, at most ``pivots`` of them; every row belongs to its
    nearest one. A cell of more than ``block_rows`` rows is cut into rings of equal size by distance quantiles, a
    ring that is still larger (ties) into blocks by hash. Null vectors and vectors with a null or non-finite
    component are nobody's neighbour. All vectors must have one length.
    """
    ship_package(train.sparkSession)
    rows = train.select(
        F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("v"), F.col(target).alias("target")
    ).where(_finite("v"))
    rows = stage(_top(rows, [F.xxhash64("v"), F.col("v")], ["neighbour"], k, "copy"), "neighbours")
    n = rows.count()
    block_rows = max(block_rows, min(MOST_ROWS, n // BLOCKS))
    size = max(1, min(pivots, math.ceil(4 * n / block_rows)))
    drawn = rows.where("copy = 1").orderBy(F.xxhash64("v"), "neighbour").limit(size).select("v").collect()
    centres = np.array([r.v for r in drawn], float) if drawn else np.zeros((0, 1))

    def place(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            cells, gaps = [np.zeros(0, "int32")], [np.zeros(0)]
            for start in range(0, len(column), 1024):
                d = _to_pivots(np.stack(column.iloc[start : start + 1024].to_numpy()), centres)
                cells.append(d.argmin(axis=1).astype("int32"))
                gaps.append(d.min(axis=1))
            yield pd.DataFrame({"cell": np.concatenate(cells), "r": np.concatenate(gaps)})

    placed = rows.drop("copy").withColumn("_at", F.pandas_udf(place, "cell int, r double")("v"))
    placed = stage(placed.select("neighbour", "v", "target", "_at.cell", "_at.r"), "placed")
    counts = np.zeros(len(centres), "int64")
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
        counts[row.cell] = row.n
    most = max(1, math.ceil(counts.max() / block_rows)) if len(counts) else 1
    fine = min(RINGS, most)
    if fine == 1:
        ringed = placed.withColumn("ring", F.lit(0))
    else:
        shares = [i / fine for i in range(1, fine)]
        edges = placed.groupBy("cell").agg(
            F.least(F.lit(fine), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("b"),
            F.percentile_approx("r", shares, 10 * fine).alias("q"),
        )
        chosen = F.expr(f"IF(b = 1, array(), transform(sequence(1, b - 1), j -> q[CAST(j * {fine} / b AS INT) - 1]))")
        edges = F.broadcast(edges.select("cell", chosen.cast("array<double>").alias("edges")))  # one row per pivot
        ring = F.size(F.filter("edges", lambda e: e < F.col("r")))
        ringed = placed.join(edges, "cell").withColumn("ring", ring).drop("edges")
    ringed = stage(ringed, "ringed")
    rings = ringed.groupBy("cell", "ring").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"),
        F.min("r").alias("lo"),
        F.max("r").alias("hi"),
    )
    rings = stage(rings, "rings")
    hot = rings.where(F.col("n") * 1000 > n).orderBy(F.desc("n")).limit(999)
    rows = join_lookup(ringed, rings.select("cell", "ring", "blocks"), ["cell", "ring"], hot=hot)
    block = F.pmod(F.xxhash64("neighbour"), F.col("blocks")).cast("int")
    rows = stage(rows.select("neighbour", "v", "target", "cell", "ring", block.alias("block")), "indexed")
    return NeighbourIndex(rows, rings, centres, counts, k, block_rows)


def _reach(index: NeighbourIndex):
    """Per query its home cell, and the cells it may have to visit with distance and hyperplane bound.

    A row of another cell is at least half the difference of the two pivot distances away. Without a reach (null)
    the nearest cells that hold k rows are returned.
    """
    centres, counts, k = index.pivots, index.counts, index.k
    longest = np.sqrt((centres * centres).sum(axis=1)).max(initial=0.0)

    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for vectors, reaches in columns:
            home, found = [], []
            for start in range(0, len(vectors), 256):
                v = np.stack(vectors.iloc[start : start + 256].to_numpy())
                far = reaches.iloc[start : start + 256].to_numpy(float)
                slack = SLACK * (np.sqrt((v * v).sum(axis=1)) + longest)
                d = _to_pivots(v, centres)
                near = d.min(axis=1)
                home.extend(d.argmin(axis=1).tolist())
                gaps = np.maximum((d - near[:, None]) / 2 - slack[:, None], 0.0)
                for i in range(len(v)):
                    if np.isnan(far[i]):
                        order = np.argsort(d[i], kind="stable")
                        enough = int(np.searchsorted(np.cumsum(counts[order]), k)) + 1
                        cells = order[:enough]
                    else:
                        cells = np.nonzero(gaps[i] <= far[i])[0]
                    found.append(
                        [{"cell": int(c), "d": d[i, c], "gap": gaps[i, c], "slack": slack[i]} for c in cells]
                    )
            yield pd.DataFrame({"home": np.array(home, "int32"), "cells": found})

    kinds = "home int, cells array<struct<cell: int, d: double, gap: double, slack: double>>"
    return F.pandas_udf(run, kinds)


def _candidates(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """``(query, home, reach, cell, ring, blocks, n, bound)`` for the cells each query may visit."""
    at = queries.withColumn("_at", _reach(index)("v", "reach"))
    cells = at.select("query", "reach", "_at.home", F.inline("_at.cells"))
    bound = F.greatest(F.lit(0.0), F.col("gap"), F.col("d") - F.col("hi") - F.col("slack"), F.col("lo") - F.col("d") - F.col("slack"))
    return cells.join(index.rings, "cell").select("query", "home", "reach", "cell", "ring", "blocks", "n", bound.alias("bound"))


def _lots(index: NeighbourIndex, counts: np.ndarray) -> list[int]:
    """A lot per home cell: cells side by side along the longest axis of the pivots, until they hold ``block_rows`` queries."""
    spread = index.pivots - index.pivots.mean(axis=0)
    order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
    lots, lot, held = [0] * len(order), 0, 0
    for home in order:
        if held and held + counts[home] > index.block_rows:
            lot, held = lot + 1, 0
        lots[home], held = lot, held + int(counts[home])
    return lots


def _meet(index: NeighbourIndex, queries: DataFrame, visits: DataFrame) -> DataFrame:
    """The k nearest rows of every visited block, ``(query, distance, neighbour, target)``.

    Queries of near home cells visit much the same rings, so they travel together in lots of about ``block_rows``; a
    block of train rows is repeated once per lot that visits it.
    """
    counts = np.zeros(len(index.pivots), "int64")
    for row in visits.select("query", "home").distinct().groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():  # one per pivot
        counts[row.home] = row.n
    lots = [(home, lot, -(-int(counts[home]) // index.block_rows)) for home, lot in enumerate(_lots(index, counts)) if counts[home]]
    homes = visits.sparkSession.createDataFrame(lots, "home int, lot int, parts int")
    visits = visits.join(F.broadcast(homes), "home").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    place = ["lot", "part", "cell", "ring", "block"]
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = visits.select("query", *place).join(queries.select("query", "v"), "query")
    groups = visits.select(*[F.col(c).alias(f"g_{c}") for c in place]).distinct()
    same = [F.col(c) == F.col(f"g_{c}") for c in ("cell", "ring", "block")]
    t = index.rows.join(groups, same).select("neighbour", "v", "target", *[f"g_{c}" for c in place])
    types = dict(index.rows.dtypes)
    schema = f"query {dict(queries.dtypes)['query']}, distance double, neighbour {types['neighbour']}, target {types['target']}"
    return q.groupBy(*place).cogroup(t.groupBy(*[f"g_{c}" for c in place])).applyInPandas(_block_neighbours(index.k), schema)


def search(index: NeighbourIndex, queries: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The neighbours ``(query, rank, neighbour, distance, target)``, ties by train key, and ``(query, cell, ring)``
    of every ring that was visited.

    First the rings nearest to each query until they hold k rows, then all rings whose bound is within the k-th
    distance so found. Query ids are expected to be unique. Queries whose vector is null, empty or not finite, and
    all queries of an empty train table, have no neighbours.
    """
    q = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v")).where(_finite("v"))
    q = stage(q, "queries")
    kinds = dict(index.rows.dtypes)
    if not len(index.pivots):
        empty = q.limit(0)
        none = {"rank": "int", "neighbour": kinds["neighbour"], "distance": "double", "target": kinds["target"]}
        found = empty.select("query", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
        return found, empty.select("query", F.lit(0).alias("cell"), F.lit(0).alias("ring"))
    order = Window.partitionBy("query").orderBy("bound", "cell", "ring")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = _candidates(index, q.withColumn("reach", F.lit(None).cast("double")))
    first = first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < index.k).drop("_before")
    first = stage(first, "first")
    found = stage(_top(_meet(index, q, first), [F.col("query")], ["distance", "neighbour"], index.k, "rank"), "near")
    full = F.when(F.count(F.lit(1)) >= index.k, F.max("distance") * (1 + 1e-9)).otherwise(F.lit(float("inf")))
    reached = stage(q.join(found.groupBy("query").agg(full.alias("reach")), "query"), "reached")
    more = _candidates(index, reached).where("bound <= reach").join(first, ["query", "cell", "ring"], "left_anti")
    more = stage(more, "more")
    both = found.drop("rank").unionByName(_meet(index, q, more))
    near = _top(both, [F.col("query")], ["distance", "neighbour"], index.k, "rank")
    visited = first.select("query", "cell", "ring").unionByName(more.select("query", "cell", "ring"))
    return near.select("query", "rank", "neighbour", "distance", "target"), visited


def nearest_neighbours(
    queries: DataFrame,
    train: DataFrame,
    target: str,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 4096,
) -> DataFrame:
    """``(query, rank, neighbour, distance, target)``: the k closest train rows, ties by train key."""
    return search(fit_index(train, target, k, key, vector, block_rows), queries, key, vector)[0]


def vote(neighbours: DataFrame) -> DataFrame:
    """``(query, prediction)``: most frequent target among the neighbours, ties to the smallest."""
    votes = neighbours.groupBy("query", "target").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "target")).alias("b"))
    return best.select("query", F.col("b.target").alias("prediction"))


def average(neighbours: DataFrame) -> DataFrame:
    """``(query, prediction)``: mean target of the neighbours."""
    return neighbours.groupBy("query").agg(F.avg("target").alias("prediction"))
