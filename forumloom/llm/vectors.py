"""Near-duplicate vectors by cover trees and their dual traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import prepare, stage
from forumloom.llm.components import components

SAMPLE = 1024
"""Most nodes of the routing level: the index is fitted on so many vectors at most, and holds every vector."""

PER_NODE = 2000
"""Vectors of a label wanted in the care of one routing node."""

BLOCK = 2048
"""Most vectors on either side of a dual traversal; larger groups are cut into blocks that meet pairwise."""

SLACK = 1e-6
"""Bounds must clear the threshold by this much; closer pairs are decided by their cosine."""


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested levels over unit vectors: the centres of a level are at least its radius apart and cover
    their subtree; the radius halves from level to level until every vector is a node of its own.

    Points are stored so that a subtree is a range. ``nodes[level]`` has, for each node, its centre, range
    and true covering radius; ``children`` the range of its children in the next level.
    """

    def __init__(self, vectors: np.ndarray, levels: int = 5):
        self.order = np.arange(len(vectors))
        groups, radius = [(0, len(vectors))], 1.0
        self.nodes = []
        for level in range(levels + 1):
            centre, start, end, cover, first_child = [], [], [], [], []
            new: list[tuple[int, int]] = []
            for a, b in groups:
                centre.append(self.order[a])
                start.append(a)
                end.append(b)
                if b - a > 1:
                    own = vectors[self.order[a:b]]
                    cover.append(float(distances(own[:1], own).max()) + 1e-9)
                else:
                    cover.append(0.0)
                first_child.append(len(new))
                if level == levels or b - a == 1:
                    new += [(i, i + 1) for i in range(a, b)] if level < levels else []
                else:
                    new += self._split(vectors, a, b, radius)
            self.nodes.append(tuple(map(np.array, (centre, start, end, cover, [*first_child, len(new)]))))
            groups, radius = new, radius / 2

    def _split(self, vectors: np.ndarray, a: int, b: int, radius: float) -> list[tuple[int, int]]:
        """Greedy net of the range: centres more than ``radius`` apart, each point with the first centre in reach."""
        members = self.order[a:b]
        label, left, centres = np.full(len(members), -1), np.arange(len(members)), 0
        while len(left):
            near = distances(vectors[members[left[:1]]], vectors[members[left]])[0] <= radius
            near[0] = True
            label[left[near]] = centres
            left = left[~near]
            centres += 1
        by_label = np.argsort(label, kind="stable")
        self.order[a:b] = members[by_label]
        cuts = a + np.searchsorted(label[by_label], np.arange(centres + 1))
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def dual_links(
    homes: np.ndarray, guests: np.ndarray, weights: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two sets of unit vectors: the weight linked to each home, and edges that connect what is linked.

    The trees are descended together. A pair of nodes is dropped if no pair of their points can be close
    enough, and taken as a whole if all must be; the rest goes to the children and in the end to single points,
    whose cosine decides. Edges are fewer than the links of a node pair taken whole.
    """
    near = float(np.sqrt(2 - 2 * threshold))
    left, right = CoverTree(homes), CoverTree(guests)
    sums = np.concatenate([[0.0], np.cumsum(weights[right.order])])
    gain = np.zeros(len(homes) + 1)
    single = np.zeros(len(homes))
    edges_a, edges_b = [], []
    last = len(left.nodes) - 1

    def points(p: np.ndarray, q: np.ndarray):
        """Exact comparison of the home points ``p`` and guest points ``q`` (places in the trees' order)."""
        for i in range(0, len(p), 512):
            part = p[i : i + 512]
            hit = homes[left.order[part]] @ guests[right.order[q]].T >= threshold
            single[part] += hit @ weights[right.order[q]]
            rows, columns = np.nonzero(hit)
            edges_a.append(left.order[part[rows]])
            edges_b.append(right.order[q[columns]])

    def descend(level: int, p: np.ndarray, q: np.ndarray):
        centre_p, start_p, end_p, cover_p, child_p = left.nodes[level]
        centre_q, start_q, end_q, cover_q, child_q = right.nodes[level]
        for i in range(0, len(p), 512):
            part = p[i : i + 512]
            d = distances(homes[centre_p[part]], guests[centre_q[q]])
            spread = cover_p[part][:, None] + cover_q[q][None, :]
            maybe = d - spread <= near + SLACK
            whole = maybe & (d + spread < near - SLACK)
            for k, n in enumerate(part):
                taken = q[whole[k]]
                if len(taken):
                    total = (sums[end_q[taken]] - sums[start_q[taken]]).sum()
                    gain[start_p[n]] += total
                    gain[end_p[n]] -= total
                    one = left.order[start_p[n]]
                    reach = np.concatenate([right.order[start_q[t] : end_q[t]] for t in taken])
                    edges_a.append(np.full(len(reach), one))
                    edges_b.append(reach)
                    rest = left.order[start_p[n] + 1 : end_p[n]]
                    edges_a.append(rest)
                    edges_b.append(np.full(len(rest), reach[0]))
                open_ = q[maybe[k] & ~whole[k]]
                if not len(open_):
                    continue
                size_p, size_q = end_p[n] - start_p[n], (end_q[open_] - start_q[open_]).sum()
                if level == last or size_p * size_q <= 4096 or size_p == 1 and size_q == len(open_):
                    points(
                        np.arange(start_p[n], end_p[n]),
                        np.concatenate([np.arange(start_q[t], end_q[t]) for t in open_]),
                    )
                else:
                    descend(
                        level + 1,
                        np.arange(child_p[n], child_p[n + 1]),
                        np.concatenate([np.arange(child_q[t], child_q[t + 1]) for t in open_]),
                    )

    if len(homes) and len(guests):
        descend(0, np.array([0]), np.array([0]))
    out = np.zeros(len(homes))
    out[left.order] = np.cumsum(gain[:-1]) + single
    a = np.concatenate(edges_a) if edges_a else np.zeros(0, np.int64)
    b = np.concatenate(edges_b) if edges_b else np.zeros(0, np.int64)
    return out, a, b


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id in the edges, the smallest id it is connected with."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is
    at least ``threshold``. Equal vectors become one with a weight first. A routing level, fitted on a
    bounded sample, gives each vector a home at its nearest node; it also visits, as a guest, every node
    that may be home to a vector within reach by the covering radius or by the plane between two nodes.
    Homes and guests meet in blocks of at most ``BLOCK``, so no task holds more than two blocks, and in each
    block the cover trees of both sides are traversed together. Tasks return link counts and connecting
    edges, not pairs.

    Vectors that are null, empty, all zero, or with a null or non-finite component, and those without a label or id,
    have no links; vectors of different lengths are not linked. Each vector is first scaled by a power of two, so
    very large and very small components neither overflow nor vanish. Repeated ids are one vertex, whose links are
    added up. An empty table gives no rows; other columns are ignored.
    """
    prepare(vectors)
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    good = F.expr(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"
    )
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    power = F.least(F.greatest(-F.floor(F.log2(largest)), F.lit(-1000)), F.lit(1000)).cast("double")
    # bound in a one-element array: a merged projection would compute the factor again for every component
    scaled = F.get(F.transform(F.array("_by"), lambda by: F.transform("v", lambda x: x * by)), F.lit(0))
    rows = rows.withColumn("_by", F.when(F.coalesce(good, F.lit(False)), F.pow(F.lit(2.0), power)))
    rows = rows.select("id", "label", F.when(F.col("_by").isNotNull(), scaled).otherwise(F.col("v")).alias("v"))
    classes = stage(
        rows.where(F.coalesce(good, F.lit(False)))
        .groupBy("label", F.transform("v", lambda x: x + 0.0).alias("v"))
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
        .withColumn("width", F.size("v")),
        "vectors",
    )
    named = classes.select(F.xxhash64("label", "width").alias("part"), "id", "m", "v")
    sizes = classes.groupBy("label", "width").count().agg(F.max("count"), F.sum("count")).first()
    nodes = min(SAMPLE, max(8, -(-(sizes[0] or 0) // PER_NODE)))
    step = F.ceil(F.log2(F.col("width"))).cast("int")  # lengths up to a power of two go together, filled up with zeros
    widths = sorted(r[0] for r in classes.select(step).distinct().collect())  # at most 31
    counted, edges = None, None
    for width in widths:  # nearly always one
        own = named.where(F.ceil(F.log2(F.size("v"))) == width)
        longest = own.agg(F.max(F.size("v"))).first()[0]
        own = own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))
        n, e = _links(own, nodes, threshold)
        counted, edges = (n, e) if counted is None else (counted.unionByName(n), edges.unionByName(e))
    plain = rows.select(F.col("id").alias(key))
    if counted is None:
        return plain.select(
            key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept")
        )
    per_class = counted.groupBy("id").agg(F.sum("n").alias("n"))
    # every row back to its class: equal rows share it
    members = (
        rows.where(F.coalesce(good, F.lit(False)))
        .select("id", F.xxhash64("label").alias("l"), F.xxhash64(F.transform("v", lambda x: x + 0.0), F.lit(1)).alias("h"), "label", "v")
        .join(
            classes.where("m > 1").select(
                F.xxhash64("label").alias("l"), F.xxhash64("v", F.lit(1)).alias("h"), F.col("id").alias("rep"),
                F.col("label").alias("label2"), F.col("v").alias("v2"), "m",
            ),
            ["l", "h"],
            "left",
        )
        .where("label2 IS NULL OR (label = label2 AND v = v2)")
        .select("id", F.coalesce("rep", "id").alias("rep"))
    )
    members = stage(members, "members")
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = components(edges.union(copies))
    links = members.join(per_class.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(
        F.sum(F.coalesce("n", F.lit(0.0))).cast("long").alias("n_links")
    )
    return (
        rows.select("id")
        .join(links, "id", "left")
        .join(found, "id", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _links(named: DataFrame, nodes: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Link counts ``(id, n)``, the other copies of the vector included, and edges ``(a, b)``."""
    spark = named.sparkSession
    sample = named.orderBy(F.xxhash64("id"), "id").limit(nodes).select("v").collect()
    centres = unit(np.array([r.v for r in sample], float))
    shared = spark.sparkContext.broadcast(centres)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(unit(np.stack(batch.v.to_numpy()).astype(float)), shared.value)
                yield batch.assign(home=d.argmin(1).astype(np.int32), away=d.min(1))

    settled = stage(named.mapInPandas(settle, "part long, id long, m long, v array<double>, home int, away double"), "homes")
    reach = np.full(len(centres), -1.0)
    counts = settled.groupBy("part", "home").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n"))
    for r in counts.groupBy("home").agg(F.max("away").alias("away")).collect():  # one row a node
        reach[r.home] = r.away
    near = float(np.sqrt(2 - 2 * threshold))
    told = spark.sparkContext.broadcast((centres, reach, distances(centres, centres)))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, cover, apart = told.value
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                d = distances(unit(np.stack(part.v.to_numpy()).astype(float)), centre)
                home = part.home.to_numpy()
                own = d[np.arange(len(d)), home]
                # to come within reach of a vector nearest to another node, a vector must be this close to the plane between
                plane = d**2 - own[:, None] ** 2 <= 2 * near * apart[home] + SLACK
                go = (cover[None, :] >= 0) & (d <= cover[None, :] + near + SLACK) & plane
                go[np.arange(len(d)), home] = True
                row, node = np.nonzero(go)
                out = part.iloc[row][["part", "id", "m", "v"]]
                yield out.assign(node=node.astype(np.int32))

    guests = settled.mapInPandas(visit, "part long, id long, m long, v array<double>, node int")
    # a node's homes and guests in blocks, each at most BLOCK on average; the counts say how many
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    guests = stage(guests, "guests")
    visits = guests.groupBy("part", "node").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.col("node").alias("node"), blocks.alias("guest_blocks")
    )
    homes = counts.select("part", F.col("home").alias("node"), blocks.alias("home_blocks"))
    grid = stage(homes.join(visits, ["part", "node"]), "grid")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    left = settled.withColumn("node", F.col("home")).join(grid, ["part", "node"]).select(
        "part", "node", place("home_blocks").alias("hb"),
        F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("gb"), F.lit(True).alias("is_home"), "id", "m", "v",
    )
    right = guests.join(grid, ["part", "node"]).select(
        "part", "node", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("hb"),
        place("guest_blocks").alias("gb"), F.lit(False).alias("is_home"), "id", "m", "v",
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        home, guest = frame[frame.is_home], frame[~frame.is_home]
        if not len(home) or not len(guest):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x, y = (unit(np.stack(f.v.to_numpy()).astype(float)) for f in (home, guest))
        total, a, b = dual_links(x, y, guest.m.to_numpy(float), threshold)
        ids, others = home.id.to_numpy(), guest.id.to_numpy()
        total -= np.isin(ids, others)  # a vector meets itself among the guests of its home
        one, root = roots(ids[a], others[b]) if len(a) else (ids[:0], ids[:0])
        apart = one != root
        return pd.concat(
            [
                pd.DataFrame({"a": ids, "b": ids, "n": total}),
                pd.DataFrame({"a": root[apart], "b": one[apart], "n": np.zeros(int(apart.sum()))}),
            ]
        )

    met = stage(
        left.unionByName(right).groupBy("part", "node", "hb", "gb").applyInPandas(meet, "a long, b long, n double"), "links"
    )
    counted = met.where("a = b").select(F.col("a").alias("id"), "n")
    return counted, met.where("a <> b").select("a", "b")
