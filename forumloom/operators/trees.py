"""Trees, forests and boosting over sparse features, grown level by level from histograms.

Train rows are stored as blocks whose cells are sorted by column and bin, so that sums are added up without sorting.
A level of all trees that grow together is one job. The rows that lack a column are the node's total less what the
column's cells hold, so no cell is ever made for a zero and the width of the features does not matter.

Up to ``ROWS_HELD`` numbers of rows a block has all cells of some columns, and tasks know the node of every row. Each finds
the best splits of its own columns and says which rows go right, as bits: a level is a job without a shuffle, and cells
are passed over where a bound on the gain shows that their column cannot win. The driver holds the trees and a few numbers
a row. Of more rows a block has some rows with all their cells: tasks sum statistics per (tree, node, column, bin), a shuffle
brings the sums of a column together, each part returns its best split per node, and the driver holds the trees alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.session import ship_package, stage

CELLS_PER_TASK = 1 << 20
"""Most cells in a block of train rows."""

BINS_AT_ONCE = 1 << 21
"""Sums of a tree's nodes, bins and labels that a task adds up in one array."""

TREES_PER_PART = 4
"""Whole trees whose sums a part takes."""

MAX_SPLITS = 10_000
"""Most splits of parts that the driver compares; of more, tasks take the best per node first."""

REFRESH = 20
"""Boosting rounds after which the scores of the train rows are stored, where the driver does not hold them."""

ROWS_HELD = 1 << 24
"""Most numbers (rows times outputs, 8 bytes each) that the driver and every task hold of the train rows."""

NODES_SENT = 1 << 25
"""Most nodes of rows that are sent to the tasks at once, a byte each; trees beyond that grow later."""

LEADERS = 64
"""Columns of a block that are tried first, for a gain that the others must be able to reach."""

MIDDLE, SPAN = 1 << 9, 1 << 10
"""Bins are numbered from the one that holds zero; these shift them into whole codes."""

_PIECES = "part int, block long, kind string, a binary, b binary, c binary"
_BLOCKS = "row binary, label binary, margin binary, codes binary, starts binary, at binary"
_COLUMNS = "codes binary, starts binary, at binary, first binary, column binary, cut binary"
_SUMS = "part int, codes binary, sums binary"
_SPLITS = "tree int, node int, gain double, column int, bin int, left array<double>, right array<double>"


# Rows and bins ---------------------------------------------------------------------------------------


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)


def vector_cells(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the cells of ML vectors other than zero, sparse or dense, sorted by row and column."""
    sparse = np.asarray(vectors.field("type")) == 0
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = np.diff(_offsets(values))
    row = np.repeat(np.arange(len(vectors)), sizes)
    value = np.asarray(values.flatten(), np.float64)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    column[sparse[row]] = np.asarray(indices.flatten(), np.int64)
    there = value != 0
    return row[there], column[there], value[there]


def cuts_of(column: np.ndarray, value: np.ndarray, max_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and boundary, sorted, from all cells of some columns sorted by column and value.

    Boundaries stand half way between the values of a column, zero among them. All values count where a column has
    at most ``max_bins``; others give their quantiles.
    """
    if not len(column):
        return column, value
    fresh = np.concatenate([[True], column[1:] != column[:-1]])
    first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    distinct = fresh | np.concatenate([[True], value[1:] != value[:-1]])
    n, d = np.bincount(group), np.bincount(group, distinct)
    listed = distinct & (d[group] <= max_bins)
    many = np.flatnonzero(d > max_bins)
    rank = np.maximum(np.ceil(np.arange(max_bins + 1) / max_bins * n[many][:, None]), 1).astype(np.int64) - 1
    owner = np.concatenate([group[listed], np.repeat(many, max_bins + 1), np.arange(len(first))])
    points = np.concatenate([value[listed], value[first[many][:, None] + rank].ravel(), np.zeros(len(first))])
    order = np.lexsort((points, owner))
    owner, points = owner[order], points[order]
    kept = np.concatenate([[True], (owner[1:] != owner[:-1]) | (points[1:] != points[:-1])])
    owner, points = owner[kept], points[kept]
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    return column[first][owner[pair]], points[pair] + (points[pair + 1] - points[pair]) / 2


def bins_of(column: np.ndarray, value: np.ndarray, cut_column: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Boundaries of its column below each value, less those below zero."""
    is_cut = np.concatenate([np.zeros(len(column), bool), np.ones(len(cut), bool)])
    both, at = np.concatenate([column, cut_column]), np.concatenate([value, cut])
    order = np.lexsort((is_cut, at, both))  # a value stands before a boundary that equals it
    below = np.empty(len(order), np.int64)
    below[order] = np.cumsum(is_cut[order])
    before = np.searchsorted(cut_column, column)
    negative = np.concatenate([[0], np.cumsum(cut < 0)])
    return below[: len(column)] - before - (negative[np.searchsorted(cut_column, column, "right")] - negative[before])


def sorted_bins(column: np.ndarray, value: np.ndarray, cut_column: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """As ``bins_of``, of cells sorted by column and value."""
    before = np.searchsorted(cut_column, column)
    negative = np.concatenate([[0], np.cumsum(cut < 0)])
    below = np.searchsorted(_pairs(cut_column, cut), _pairs(column, value))  # pairs are ordered by column, then value
    return below - before - (negative[np.searchsorted(cut_column, column, "right")] - negative[before])


def _pairs(column: np.ndarray, value: np.ndarray) -> np.ndarray:
    found = np.empty(len(column), np.complex128)
    found.real, found.imag = column, value
    return found


def fit_cuts(cells: DataFrame, max_bins: int = 32) -> DataFrame:
    """``(column, cuts)`` from cells ``(column, value)``, the cells of a column read by one task."""
    ship_package(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(batch.column(c)) for c in ("column", "value")] for batch in batches]
        if held:
            column, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((value, column))
            yield _cut_lists(*cuts_of(column[order], value[order], max_bins))

    parted = cells.select(F.col("column").cast("int").alias("column"), F.col("value").cast("double").alias("value"))
    return parted.repartition("column").mapInArrow(run, "column int, cuts array<double>")


def _cut_lists(column: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    own, starts = np.unique(column, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cut)).astype(np.int32)), pa.array(cut, pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists], ["column", "cuts"])


def _arrays(kind: str, *arrays: np.ndarray) -> dict:
    """A row of ``_PIECES`` but for its block and part."""
    return {"kind": kind} | {name: x.tobytes() for name, x in zip(("a", "b", "c"), arrays, strict=True)}


def _pieces(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("part", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), *[(x, pa.binary()) for x in "abc"]]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


@dataclass(frozen=True)
class Packing:
    """Rows become blocks of about ``cells`` cells: a piece per part of the columns, and one with rows and labels.

    With ``firsts``, the number of the first row of each partition, cells name rows by their number among all.
    """

    cells: int
    parts: int
    firsts: dict[int, int] | None = None

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = _offsets(batch.column("features").field("values"))
            begin = 0
            while begin < batch.num_rows:
                end = max(int(np.searchsorted(held, held[begin] + self.cells, "right")) - 1, begin + 1)
                yield self._packed(batch.slice(begin, end - begin), block)
                block, begin = block + 1, end

    def _packed(self, batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        at, column, value = vector_cells(pa.concat_arrays([batch.column("features")]))
        lists = _by_part(column, self.parts)
        rows, labels = (np.asarray(batch.column(c)) for c in ("row", "label"))
        if self.firsts is not None:
            at = row_numbers(rows, self.firsts)[at]
            cells = [_arrays("cells", column[x].astype(np.int32), value[x], at[x].astype(np.int32)) for x in lists]
            return _pieces([{"part": p, "block": block} | x for p, x in enumerate(cells) if x["a"]])
        cells = [_arrays("cells", column[x].astype(np.int64), value[x], at[x].astype(np.int32)) for x in lists]
        head = {"part": block % self.parts, "block": block} | _arrays("rows", rows.astype(np.int64), labels.astype(np.float64), np.zeros(0))
        return _pieces([head, *[{"part": p, "block": block} | x for p, x in enumerate(cells) if x["a"]]])


def row_numbers(rows: np.ndarray, firsts: dict[int, int]) -> np.ndarray:
    """Numbers from 0 of rows with Spark's increasing ids."""
    known, first = (np.array(x, np.int64) for x in zip(*sorted(firsts.items()), strict=True))
    return first[np.searchsorted(known, rows >> 33)] + (rows & ((1 << 33) - 1))


def _by_part(column: np.ndarray, parts: int) -> list[np.ndarray]:
    """Positions of each part's columns, in order."""
    if parts == 1:
        return [np.arange(len(column))]
    part = column % parts
    part = part.astype(np.uint16) if parts < 1 << 16 else part  # few parts are sorted by their digits
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@dataclass(frozen=True)
class Binning:
    """Finds the boundaries of a part's columns and puts bins in place of values."""

    max_bins: int

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["kind"] == "rows":
                    yield _pieces([piece])
                    continue
                if piece["part"] != current and held:
                    yield from self._binned(held)
                    held = []
                current = piece["part"]
                held.append(piece)
        if held:
            yield from self._binned(held)

    def _binned(self, held: list[dict]) -> Iterator[pa.RecordBatch]:
        column = np.concatenate([np.frombuffer(x["a"], np.int64) for x in held])
        value = np.concatenate([np.frombuffer(x["b"], np.float64) for x in held])
        order = np.lexsort((value, column))
        cut_column, cut = cuts_of(column[order], value[order], self.max_bins)
        bins = bins_of(column, value, cut_column, cut)
        yield _pieces([{"part": held[0]["part"], "block": -1} | _arrays("cuts", cut_column, cut, np.zeros(0))])
        ends = np.cumsum([len(x["a"]) // 8 for x in held])
        for piece, own in zip(held, np.split(bins, ends[:-1]), strict=True):
            yield _pieces([piece | {"b": own.astype(np.int64).tobytes()}])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their cells sorted by column, bin and row."""
    current, held = None, []
    for batch in batches:
        for piece in batch.to_pylist():
            if piece["block"] != current and held:
                yield _block(held)
                held = []
            current = piece["block"]
            held.append(piece)
    if held:
        yield _block(held)


def _block(held: list[dict]) -> pa.RecordBatch:
    head = next(x for x in held if x["kind"] == "rows")
    cells = [x for x in held if x["kind"] == "cells"]
    column, bins = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x[c], np.int64) for x in cells]]) for c in "ab")
    at = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x["c"], np.int32) for x in cells]])
    code = column * SPAN + bins + MIDDLE
    order = np.lexsort((at, code))
    codes, starts = np.unique(code[order], return_index=True)
    arrays = [head["a"], head["b"], b"", codes.tobytes(), np.append(starts, len(at)).astype(np.int64).tobytes(), at[order].tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in arrays], [c.split()[0] for c in _BLOCKS.split(", ")])


def _stored(train: DataFrame, label: str) -> DataFrame:
    """Train rows stored once, with ids and labels."""
    rows = train.select(F.col("features"), F.col(label).cast("double").alias("label"))
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "tree-rows")


@dataclass(frozen=True)
class Extent:
    """Rows, the greatest label, the width of the features, most cells of a block and parts of the columns: one per core at least."""

    n: int
    label: float
    width: int
    cells: int
    parts: int


def _extent(rows: DataFrame) -> Extent:
    widest, sizes = F.arrow_udf(widths, "long"), F.arrow_udf(_sizes, "long")
    wanted = F.max("label"), F.max(widest("features")), F.sum(sizes("features"))
    n, label, width, total = rows.agg(F.count(F.lit(1)), *[F.coalesce(x, F.lit(0)) for x in wanted]).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cells = max(min(CELLS_PER_TASK, -(-total // cores)), 1)
    return Extent(n, label, int(width) or 1, cells, max(1, -(-total // cells)))


def _binned(train: DataFrame, label: str, max_bins: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of train rows with binned cells, the table of boundaries, both stored once, and the width."""
    rows = _stored(train, label)
    return _row_blocks(rows, _extent(rows), max_bins)


def _row_blocks(rows: DataFrame, extent: Extent, max_bins: int) -> tuple[DataFrame, DataFrame, int]:
    """As ``_binned``, of stored rows.

    The cells of a part of the columns meet in one task, as arrays: it finds the boundaries and sends bins back to the
    blocks. There are no rows per cell, and no table of boundaries is sent to the tasks.
    """
    cells, parts = extent.cells, extent.parts
    packed = rows.select("row", "label", "features").mapInArrow(Packing(cells, parts).run, _PIECES)
    binned = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(Binning(max_bins).run, _PIECES)
    pieces = stage(binned, "pieces")
    blocks = pieces.where("block >= 0").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_assembled, _BLOCKS)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                yield _cut_lists(np.frombuffer(piece["a"], np.int64), np.frombuffer(piece["b"], np.float64))

    cuts = pieces.where("block < 0").mapInArrow(listed, "column int, cuts array<double>")
    return stage(blocks, "binned"), stage(cuts, "cuts"), extent.width


@dataclass(frozen=True)
class ColumnBinning:
    """Finds the boundaries of a part's columns and makes a block of their cells, sorted by column, value and row."""

    max_bins: int

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for part, a, b, c in zip(*(batch.column(x) for x in ("part", "a", "b", "c")), strict=True):
                if part.as_py() != current and held:
                    yield self._block(held)
                    held = []
                current = part.as_py()
                held.append((np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer()), np.frombuffer(c.as_buffer(), np.int32)))
        if held:
            yield self._block(held)

    def _block(self, held: list[tuple]) -> pa.RecordBatch:
        column, value, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, value, column))
        column, value, at = column[order].astype(np.int64), value[order], at[order]
        cut_column, cut = cuts_of(column, value, self.max_bins)
        code = column * SPAN + sorted_bins(column, value, cut_column, cut) + MIDDLE
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        fresh = np.concatenate([[True], column[starts[1:]] != column[starts[:-1]]])
        arrays = (code[starts], np.append(starts, len(code)).astype(np.int64), at, np.flatnonzero(fresh), cut_column, cut)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], [c.split()[0] for c in _COLUMNS.split(", ")])


def _listed_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for column, cut in zip(batch.column("column"), batch.column("cut"), strict=True):
            yield _cut_lists(np.frombuffer(column.as_buffer(), np.int64), np.frombuffer(cut.as_buffer(), np.float64))


class Cells:
    """A block of rows whose cells are found by column and bin."""

    def __init__(self, n: int, codes: np.ndarray, starts: np.ndarray, at: np.ndarray, width: int):
        self.n, self.codes, self.starts, self.at, self.width = n, codes, starts, at, width
        self.columns, self.first = np.unique(codes // SPAN, return_index=True)
        self.code = np.repeat(np.arange(len(codes)), np.diff(starts))

    def walk(self, column: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """The node of each tree (first axis) in which each row ends; a bin above ``at`` goes right."""
        found = np.zeros((len(column), self.n), np.int64)
        for node, split, last in zip(found, column, at, strict=True):
            for level in range(depth):
                own = [i for i in range(2**level - 1, 2 ** (level + 1) - 1) if split[i] >= 0]
                if not own:
                    continue
                right = 0 > last[node]
                for i in own:
                    low, high = np.searchsorted(self.codes, [split[i] * SPAN, (split[i] + 1) * SPAN])
                    cells = slice(self.starts[low], self.starts[high])
                    rows = self.at[cells]
                    here = node[rows] == i
                    right[rows[here]] = (self.codes[self.code[cells][here]] % SPAN - MIDDLE) > last[i]
                node[:] = np.where(split[node] >= 0, 2 * node + 1 + right, node)
        return found


class Block:
    """Some rows and their cells, found by row and column."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.n, self.row, self.column, self.value, self.width = n, row, column, value, width
        self.codes = row * width + column

    def walk(self, column: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """The node of each tree (first axis) in which each row ends; a value above ``at`` goes right."""
        trees, rows = np.arange(len(column))[:, None], np.arange(self.n)[None, :]
        node = np.zeros((len(column), self.n), np.int64)
        for _ in range(depth):
            split = column[trees, node]
            wanted = rows * self.width + split
            place = np.minimum(np.searchsorted(self.codes, wanted), max(len(self.codes) - 1, 0))
            value = np.where(self.codes[place] == wanted, self.value[place], 0) if len(self.codes) else np.zeros(node.shape)
            node = np.where(split >= 0, 2 * node + 1 + (value > at[trees, node]), node)
        return node


# Trees -----------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of one depth in heap order: node i has children 2i + 1 and 2i + 2; a leaf has column -1.

    ``at`` is the last bin that goes left; ``stats`` are sums over the node's rows.
    """

    depth: int
    column: np.ndarray
    at: np.ndarray
    stats: np.ndarray

    @classmethod
    def roots(cls, n: int, depth: int, n_stats: int) -> Trees:
        size = 2 ** (depth + 1) - 1
        return cls(depth, np.full((n, size), -1), np.zeros((n, size)), np.zeros((n, size, n_stats)))


@dataclass(frozen=True)
class ClassCounts:
    """Statistics of classifying trees: the weight of each class.

    With ``bootstrap`` a row counts as often in a tree as a Poisson variable of its hash says; with ``votes`` rows
    weigh more the more of the weighted trees before miss them.
    """

    n_classes: int
    seed: int = 42
    bootstrap: bool = False
    votes: tuple[Trees, np.ndarray] | None = None
    gini = True

    @property
    def n_labels(self) -> int:
        """Statistics that are told apart by a row's label."""
        return self.n_classes

    def weights(self, block: Block, row: np.ndarray, label: np.ndarray, n_trees: int) -> np.ndarray:
        weight = np.ones((n_trees, block.n))
        if self.bootstrap:
            u = _uniform(row[None, :], np.arange(n_trees)[:, None], self.seed)
            weight = np.searchsorted(_POISSON, u).astype(np.float64)
        if self.votes is not None:
            trees, amounts = self.votes
            chosen = trees.stats.argmax(axis=2)[np.arange(len(amounts))[:, None], block.walk(trees.column, trees.at, trees.depth)]
            missed = (chosen != label[None, :]).astype(np.float64)
            weight = weight * np.exp((amounts[:, None] * missed).sum(axis=0) - amounts.sum() / 2)
        return weight

    def parts(self, block, row, label, margin, n_trees):
        for weight in self.weights(block, row, label, n_trees):
            yield weight > 0, label.astype(np.int64), weight[None, :]

    def drawn(self, t: int, row: np.ndarray, label: np.ndarray, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Weight and label of each row in a tree; ``given`` are weights."""
        weight = np.ones(len(row)) if given is None else given
        if self.bootstrap:
            weight = np.searchsorted(_POISSON, _uniform(row, t, self.seed)).astype(np.float64)
        return weight, label.astype(np.int64)

    def statistics(self, rows: np.ndarray, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(value[rows], weight[rows], self.n_classes)


@dataclass(frozen=True)
class Residuals:
    """Statistics of boosting: rows, residuals, and what the leaf's step divides by.

    The score of a row is its stored margin and the trees since. With classes the loss is the multinomial deviance and
    a round has one tree per class (Friedman, "Greedy function approximation", 2001); else it is the squared error.
    """

    start: np.ndarray
    classes: bool
    since: tuple[tuple[Trees, np.ndarray], ...] = ()
    gini = False
    n_labels = 1

    def scores(self, block: Block, margin: np.ndarray) -> np.ndarray:
        total = margin.T if margin.size else np.repeat(self.start[:, None], block.n, axis=1)
        for trees, step in self.since:
            total = total + step[np.arange(len(step))[:, None], block.walk(trees.column, trees.at, trees.depth)]
        return total

    def parts(self, block, row, label, margin, n_trees):
        score = self.scores(block, margin)
        everyone, none, one = np.ones(block.n, bool), np.zeros(block.n, np.int64), np.ones(block.n)
        if not self.classes:
            yield everyone, none, np.stack([one, label - score[0], one])
            return
        chance = softmax(score)
        for k in range(n_trees):
            residual = (label == k) - chance[k]
            size = np.abs(residual)
            yield everyone, none, np.stack([one, residual, size * (1 - size)])

    def drawn(self, t: int, row: np.ndarray, label: np.ndarray, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Weight and value of each row in a tree; ``given`` are the residuals of every tree."""
        return np.ones(len(row)), given[t]

    def statistics(self, rows: np.ndarray, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
        own, value = weight[rows], value[rows]
        size = np.abs(value)
        return np.array([own.sum(), (own * value).sum(), (size * (1 - size)).sum() if self.classes else own.sum()])


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=0))
    return e / e.sum(axis=0)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone."""
    x = np.zeros(1, np.uint64)  # an array: it wraps around silently
    for key in keys:
        x = (x ^ np.asarray(key).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


@dataclass(frozen=True)
class Growth:
    """What tasks need to sum up a level: the trees so far, the nodes to split, the statistics and the columns tried."""

    trees: Trees
    live: np.ndarray
    target: ClassCounts | Residuals
    width: int
    parts: int
    share: float = 1.0
    seed: int = 42

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, n = [], 0
                for found in self._sums(*read_block(batch, i, self.width)):
                    held.append(found)
                    n += len(found[0])
                    if n >= CELLS_PER_TASK:
                        yield from self._parted(held)
                        held, n = [], 0
                yield from self._parted(held)

    def _parted(self, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The sums of some trees as a row per part, with the totals of their nodes in each."""
        if not held:
            return
        codes, sums, totals, over = (np.concatenate(x) for x in zip(*held, strict=True))
        lists = _by_part(block_column(codes, self.target.n_labels, self.width), self.parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(self.parts, dtype=np.int32)),
                pa.array([np.concatenate([totals, codes[x]]).tobytes() for x in lists], pa.binary()),
                pa.array([np.concatenate([over, sums[x]]).tobytes() for x in lists], pa.binary()),
            ],
            ["part", "codes", "sums"],
        )

    def _sums(self, block: Cells, row: np.ndarray, label: np.ndarray, margin: np.ndarray) -> Iterator[tuple]:
        """Codes and sums of each tree's cells and of its nodes."""
        where = block.walk(self.trees.column, self.trees.at, self.trees.depth)
        size, n_labels = self.trees.column.shape[1], self.target.n_labels
        for t, (counted, stat, values) in enumerate(self.target.parts(block, row, label, margin, len(where))):
            nodes = np.flatnonzero(self.live[t])
            number = np.full(size, -1)
            number[nodes] = np.arange(len(nodes))
            place = np.where(counted, number[where[t]], -1)
            rows = np.flatnonzero(place >= 0)
            if not len(rows):
                continue
            whole = (t * size + where[t][rows]) * (self.width + 1) * SPAN  # column 0 holds the totals of the nodes
            totals, over = _summed(whole * n_labels + stat[rows], values[:, rows])
            found = list(self._cell_sums(t, block, nodes, place, stat, values))
            codes = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in found]])
            yield codes, np.concatenate([np.zeros((0, len(values))), *[x for _, x in found]]), totals, over

    def _cell_sums(self, t: int, block: Cells, nodes, place, stat, values) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sums by node, column, bin and label, added up in arrays of a bounded number of bins at a time."""
        size, n_labels = self.trees.column.shape[1], self.target.n_labels
        n_codes = len(block.codes)
        tried = None
        if self.share < 1:  # by node and column; the bins of a column are neighbours
            tried = _uniform(t, nodes[:, None], block.columns[None, :], self.seed) < self.share
            columns = np.flatnonzero(tried.any(axis=0))
            column_of = np.repeat(np.arange(len(block.columns)), np.diff(np.append(block.first, n_codes)))
            used = np.flatnonzero(tried.any(axis=0)[column_of]) if len(columns) < len(block.columns) else np.arange(n_codes)
        else:
            used = np.arange(n_codes)
        step = max(1, BINS_AT_ONCE // (len(nodes) * n_labels))
        for begin in range(0, len(used), step):
            some = used[begin : begin + step]
            low, high = block.starts[some], block.starts[some + 1]
            if some[-1] - some[0] + 1 == len(some):
                cells = np.arange(low[0], high[-1])
            else:
                cells = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
            at, own = block.at[cells], np.repeat(np.arange(len(some)), high - low)
            node = place[at]
            here = node >= 0
            if tried is not None:
                here &= tried[node, column_of[some][own]]
            at, own, node = at[here], own[here], node[here]
            key = (node * len(some) + own) * n_labels + stat[at]
            n = len(nodes) * len(some) * n_labels
            added = [np.bincount(key, v[at], n) for v in values]
            there = np.flatnonzero(added[0] > 0)  # the first statistic is the weight of the rows
            group, label = np.divmod(there, n_labels)
            node, own = np.divmod(group, len(some))
            code = (t * size + nodes[node]) * (self.width + 1) * SPAN + block.codes[some[own]] + SPAN
            yield code * n_labels + label, np.stack([x[there] for x in added], axis=1)


def block_column(codes: np.ndarray, n_labels: int, width: int) -> np.ndarray:
    """Column of each code; -1 for totals."""
    return codes // n_labels // SPAN % (width + 1) - 1


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the sums of their values as one row each."""
    if (codes[1:] > codes[:-1]).all():
        return codes, values.T
    found, inverse = np.unique(codes, return_inverse=True)
    return found, np.stack([np.bincount(inverse, v, len(found)) for v in values], axis=1)


def read_block(batch: pa.RecordBatch, i: int, width: int) -> tuple[Cells, np.ndarray, np.ndarray, np.ndarray]:
    """Cells, rows, labels and margins of the ``i``-th block of a batch."""
    kinds = {"row": np.int64, "label": np.float64, "margin": np.float64, "codes": np.int64, "starts": np.int64, "at": np.int32}
    found = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()}
    n, margin = len(found["row"]), found["margin"]
    block = Cells(n, found["codes"], found["starts"], found["at"], width)
    return block, found["row"], found["label"], margin.reshape(n, -1) if len(margin) else margin


# Splits ----------------------------------------------------------------------------------------------


def _score(stats: np.ndarray, gini: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each side, and what a good split makes large: sum of squared sums per row."""
    n = stats.sum(axis=-1) if gini else stats[..., 0]
    top = (stats * stats).sum(axis=-1) if gini else stats[..., 1] ** 2
    return n, np.divide(top, n, out=np.zeros_like(top), where=n > 0)


def best_splits(codes: np.ndarray, values: np.ndarray, n_labels: int, size: int, width: int, gini: bool, min_rows: float) -> list[tuple]:
    """Best split per (tree, node) of one part, whose sorted codes start each node with its totals.

    Gains are compared to ten digits, and equal ones go to the smallest column and bin. A node without a split has
    a negative gain and its totals on the left.
    """
    n_stats = n_labels * values.shape[1]
    cells, sums = codes, values
    if n_labels > 1:
        cells, label = codes // n_labels, codes % n_labels
        step = np.concatenate([[True], cells[1:] != cells[:-1]])
        sums = np.zeros((int(step.sum()), n_labels))
        sums[np.cumsum(step) - 1, label] = values[:, 0]
        cells = cells[step]
    owner, rest = np.divmod(cells, SPAN * (width + 1))
    column, bins = rest // SPAN - 1, rest % SPAN - MIDDLE
    lead = column < 0
    nodes, totals = owner[lead], sums[lead]
    found = [(int(o) // size, int(o) % size, -2.0, -1, 0, t.tolist(), [0.0] * n_stats) for o, t in zip(nodes, totals, strict=True)]
    if lead.all():
        return found
    owner, column, bins, sums = owner[~lead], column[~lead], bins[~lead], sums[~lead]
    first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (column[1:] != column[:-1])])
    starts, group = np.flatnonzero(first), np.cumsum(first) - 1
    total = totals[np.searchsorted(nodes, owner[starts])]
    zero = total - np.add.reduceat(sums, starts)
    zero[np.abs(_score(zero, gini)[0]) < 1e-9] = 0
    # the rows without the column stand between a column's bins below zero and the others
    negative = np.add.reduceat((bins < 0).astype(np.int64), starts)
    n_groups, n = len(starts), len(bins) + len(starts)
    place = np.arange(len(bins)) + group + (bins >= 0)
    between = starts + negative + np.arange(n_groups)
    run, bin_of, groups = np.zeros((n, n_stats)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    run[place], run[between] = sums, zero
    bin_of[place] = bins
    groups[place], groups[between] = group, np.arange(n_groups)
    run = np.cumsum(run, axis=0)
    begin = starts + np.arange(n_groups)
    left = run - np.concatenate([np.zeros((1, n_stats)), run])[begin][groups]
    right = total[groups] - left
    (n_left, s_left), (n_right, s_right) = _score(left, gini), _score(right, gini)
    all_rows, s = (x[groups] for x in _score(total, gini))
    gain = np.round((s_left + s_right - s) / all_rows, 10)
    last = np.append(begin[1:], n) - 1
    gain[last] = -1.0
    after = np.minimum(between + 1, n - 1)  # cells in the bin of zero go left with the rows without the column
    gain[between[(groups[after] == groups[between]) & (after > between) & (bin_of[after] == 0)]] = -1.0
    gain[(n_left < min_rows) | (n_right < min_rows)] = -1.0
    owner, column = owner[starts], column[starts]
    heads = begin[np.concatenate([[True], owner[1:] != owner[:-1]])]
    most = np.maximum.reduceat(gain, heads)
    for head, end, best in zip(heads, np.append(heads[1:], n), most, strict=True):
        i = head + int(np.argmax(gain[head:end] == best))  # the first: smallest column and bin
        o = int(owner[groups[i]])
        found.append((o // size, o % size, float(best), int(column[groups[i]]), int(bin_of[i]), left[i].tolist(), right[i].tolist()))
    return found


@dataclass(frozen=True)
class Search:
    """Merges the sums of a part as they come and returns its best split per node."""

    n_labels: int
    size: int
    width: int
    gini: bool
    min_rows: float
    chunk: int = 1 << 22

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, n = None, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column("part")[row].as_py()
                if part != current and held:
                    yield self._found(*self._merged(held))
                    held, n = [], 0
                current = part
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int64)
                values = np.frombuffer(batch.column("sums")[row].as_buffer(), np.float64).reshape(len(codes), -1 if len(codes) else 1)
                held.append((codes, values))
                n += len(codes)
                if n >= self.chunk:
                    held = [self._merged(held)]
                    n = 0
        if held:
            yield self._found(*self._merged(held))

    def _merged(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        held = [h for h in held if len(h[0])] or held[:1]
        return _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).T)

    def _found(self, codes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        found = best_splits(codes, values, self.n_labels, self.size, self.width, self.gini, self.min_rows) if len(codes) else []
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def grow(
    rows: DataFrame, width: int, target: ClassCounts | Residuals, n_trees: int, depth: int, share: float = 1.0, seed: int = 42,
    min_rows: float = 1.0,
) -> Trees:
    """Grow trees together, one job per level. The driver gets one row per node of the level, or ``MAX_SPLITS`` at most."""
    n_stats = target.n_labels if target.gini else 3
    trees = Trees.roots(n_trees, depth, n_stats)
    live = np.zeros(trees.column.shape, bool)
    live[:, 0] = True
    maps = rows.rdd.getNumPartitions()
    parts = maps * max(1, int(n_trees * share) // TREES_PER_PART) if maps > 1 else 1  # sums per part stay alike for more trees
    for _ in range(depth):
        sums = rows.mapInArrow(Growth(trees, live, target, width, parts, share, seed).sums, _SUMS)
        if parts > 1:
            sums = sums.repartition(parts, "part").sortWithinPartitions("part")
        search = Search(target.n_labels, live.shape[1], width, target.gini, min_rows)
        rank = F.struct("gain", (-F.col("column")).alias("c"), (-F.col("bin")).alias("b"), "left", "right").alias("s")
        found = sums.mapInArrow(search.run, _SPLITS).select("tree", "node", rank)
        if parts * live.sum() > MAX_SPLITS:
            found = found.groupBy("tree", "node").agg(F.max("s").alias("s"))
        following = np.zeros_like(live)
        chosen: dict[tuple[int, int], tuple] = {}
        for tree, node, s in found.collect():
            chosen[tree, node] = max(chosen.get((tree, node), s), s, key=lambda x: (x.gain, x.c, x.b))
        for (tree, node), s in chosen.items():
            left, right = np.array(s.left), np.array(s.right)
            trees.stats[tree, node] = left + right
            if s.gain > 0:
                trees.column[tree, node], trees.at[tree, node] = -s.c, -s.b
                for child, stats in ((2 * node + 1, left), (2 * node + 2, right)):
                    trees.stats[tree, child] = stats
                    following[tree, child] = True
        live = following
        if not live.any():
            break
    return trees


# Blocks of columns ------------------------------------------------------------------------------------


class Columns:
    """All train cells of some columns, sorted by column and bin; rows go by their number among all."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, at: np.ndarray, first: np.ndarray):
        self.codes, self.starts, self.at, self.first = codes, starts, at, first
        self.column, self.ends = codes[first] // SPAN, np.append(first[1:], len(codes))
        self.cells = starts[self.ends] - starts[self.first]

    def sides(self, column: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a column's cells, those with a bin above ``last`` apart."""
        low, high = np.searchsorted(self.codes, [column * SPAN, (column + 1) * SPAN])
        above = low + int(np.searchsorted(self.codes[low:high], column * SPAN + MIDDLE + last, "right"))
        return self.at[self.starts[low] : self.starts[above]], self.at[self.starts[above] : self.starts[high]]

    def right(self, column: int, last: int, n: int) -> np.ndarray:
        """Which of ``n`` rows have a bin above ``last``."""
        found = np.full(n, 0 > last)
        for rows, above in zip(self.sides(column, last), (False, True), strict=True):
            found[rows] = above
        return found


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray | slice:
    """The numbers of all ranges, one after the other."""
    if len(low) and (low[1:] == high[:-1]).all():
        return slice(int(low[0]), int(high[-1]))
    sizes = high - low
    return np.repeat(high - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Found:
    """The best split of a node so far: gains are compared to ten digits, equal ones go to the smallest column and bin."""

    gain: float = -1.0
    column: int = -1
    bin: int = 0
    block: Columns | None = None

    def better(self, gain: float, column: int, last: int) -> bool:
        return (gain, -column, -last) > (self.gain, -self.column, -self.bin) if gain > 0 else False


class Level:
    """The rows of one tree in the nodes that are to be split, and the best splits that its blocks have shown.

    ``sums`` are statistics of the rows that a gain needs: with ``gini`` a row counts by its label, else weight and
    weighted value.
    """

    def __init__(self, node: np.ndarray, nodes: np.ndarray, weight: np.ndarray, value: np.ndarray, n_labels: int, gini: bool, min_rows: float):
        number = np.full(int(max(node.max(initial=0), nodes.max(initial=0))) + 2, -1)  # the last one: rows of no node
        number[nodes] = np.arange(len(nodes))
        self.place, self.nodes, self.gini, self.min_rows = number[node], nodes, gini, min_rows
        self.place[weight <= 0] = -1
        self.n_labels, self.weight, self.value = n_labels, weight, value
        there = self.place >= 0
        self.everywhere = len(nodes) == 1 and bool(there.all())
        place, self.plain = self.place[there], bool((weight[there] == 1).all())
        if gini:
            key = place * n_labels + value[there]
            self.total = np.bincount(key, weight[there], len(nodes) * n_labels).reshape(len(nodes), n_labels)
            self.size = self.total.sum(axis=1)
            share = self.total / np.where(self.size > 0, self.size, 1)[:, None]
            apart = 1 - 2 * share[place, value[there]] + (share * share).sum(axis=1)[place]
        else:
            sums = [np.bincount(place, x, len(nodes)) for x in (weight[there], weight[there] * value[there])]
            self.total, self.size = np.stack(sums, axis=1), sums[0]
            apart = (value[there] - (sums[1] / np.where(sums[0] > 0, sums[0], 1))[place]) ** 2
        self.apart = np.zeros(len(weight))
        self.apart[there] = weight[there] * apart
        self.heaviest = float(weight[there].max(initial=0))
        self.found = [Found() for _ in nodes]

    def search(self, block: Columns, tried: np.ndarray | None) -> None:
        """Compares the splits of a block's columns; ``tried`` says which columns (second axis) a node tries."""
        some = np.arange(len(block.column)) if tried is None else np.flatnonzero(tried.any(axis=0))
        for apart in (False, True)[: len(self.nodes)]:  # all nodes together show which columns need a look at each node
            if len(some) <= 4 * LEADERS:
                break
            reach, weight = self._reach(block, some, apart)
            each = LEADERS // len(reach) + 1
            leaders = np.unique(np.argpartition(-reach, each, axis=1)[:, :each])
            self._compare(block, some[leaders], tried)
            least, left = np.array([x.gain for x in self.found])[:, None], self.size[:, None] - weight
            able = ((left <= 0) | (reach * (1 + 1e-9) >= (least - 1e-9) * left)).any(axis=0)
            able[leaders] = False
            some = some[able]
        self._compare(block, some, tried)

    def _reach(self, block: Columns, some: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances from the mean of their node, and weights, of some columns' cells in each node, or bounds in all.

        A side S of any split lies within the cells of its column, and a split gains at most the squared distances in S times
        W / (W - W_S), by the inequality of Cauchy and Schwarz: what cannot reach the best gain so far need not be summed.
        """
        if not apart:
            return np.add.reduceat(self.apart[block.at], block.starts[block.first])[None, some], self.heaviest * block.cells[None, some]
        n, m = len(some), len(self.nodes)
        at = block.at[_ranges(block.starts[block.first[some]], block.starts[block.ends[some]])]
        key = (np.where(self.place >= 0, self.place, m) * n)[at] + np.repeat(np.arange(n), block.cells[some])
        sums = [np.bincount(key, x, (m + 1) * n) for x in (self.apart[at], None if self.plain else self.weight[at])]
        return tuple(x.reshape(m + 1, n)[:m] for x in sums)

    def _compare(self, block: Columns, some: np.ndarray, tried: np.ndarray | None) -> None:
        """In lots whose sums stay below ``BINS_AT_ONCE``."""
        most = max(1, BINS_AT_ONCE // (len(self.nodes) * self.n_labels))
        codes = np.cumsum(block.ends[some] - block.first[some])
        begin = 0
        while begin < len(some):
            end = max(int(np.searchsorted(codes, (codes[begin - 1] if begin else 0) + most, "right")), begin + 1)
            self._lot(block, some[begin:end], tried)
            begin = end

    def _sums(self, block: Columns, codes: np.ndarray | slice) -> list[np.ndarray]:
        """Sums of nodes and codes: of each label, or weights and weighted values."""
        low, high = block.starts[:-1][codes], block.starts[1:][codes]
        n, sizes = len(low), high - low
        at = block.at[_ranges(low, high)]
        if self.everywhere and not self.gini:
            begin = np.cumsum(sizes) - sizes
            weight = sizes.astype(np.float64) if self.plain else np.add.reduceat(self.weight[at], begin)
            value = self.value if self.plain else self.weight * self.value
            return [weight[None, :], np.add.reduceat(value[at], begin)[None, :]]
        m = len(self.nodes)
        offset = np.where(self.place >= 0, self.place, m) * n  # rows of no node are added up apart
        key = offset[at] + np.repeat(np.arange(n), sizes)
        if self.gini:
            label = self.value * ((m + 1) * n)
            key += label[at]
            sums = np.bincount(key, None if self.plain else self.weight[at], (m + 1) * n * self.n_labels)
            return list(sums.reshape(self.n_labels, m + 1, n)[:, :m].astype(np.float64))
        value = self.value if self.plain else self.weight * self.value
        found = [np.bincount(key, None if self.plain else self.weight[at], (m + 1) * n), np.bincount(key, value[at], (m + 1) * n)]
        return [x.reshape(m + 1, n)[:m].astype(np.float64) for x in found]

    def _score(self, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a side, and its sum of squared sums per row."""
        if not self.gini:
            return sums[0], sums[1] * sums[1] / sums[0]
        n, top = sums[0].copy(), sums[0] * sums[0]
        for x in sums[1:]:
            n += x
            top += x * x
        return n, top / n

    def _gains(self, left: list[np.ndarray]) -> np.ndarray:
        right = [t[:, None] - x for t, x in zip(self.total.T, left, strict=True)]
        with np.errstate(divide="ignore", invalid="ignore"):
            (n_left, s_left), (n_right, s_right) = self._score(left), self._score(right)
            whole = self._score([t[:, None] for t in self.total.T])[1]
            gain = np.round((s_left + s_right - whole) / self.size[:, None], 10)
        gain[~((n_left >= self.min_rows) & (n_right >= self.min_rows) & (n_left > 0) & (n_right > 0))] = -1.0
        return gain

    def _lot(self, block: Columns, some: np.ndarray, tried: np.ndarray | None) -> None:
        codes = _ranges(block.first[some], block.ends[some])
        sums = self._sums(block, codes)
        bins = block.codes[codes] % SPAN - MIDDLE
        sizes = block.ends[some] - block.first[some]
        first = np.cumsum(sizes) - sizes
        negative = np.add.reduceat((bins < 0).astype(np.int64), first)
        run = [np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1) for x in sums]
        zero = [t[:, None] - (r[:, first + sizes] - r[:, first]) for t, r in zip(self.total.T, run, strict=True)]
        none = np.abs(sum(zero) if self.gini else zero[0]) < 1e-9
        for x in zero:
            x[none] = 0
        # the rows without the column stand between a column's bins below zero and the others
        halves = np.stack([negative, sizes - negative], axis=1).ravel()
        left, between = [], []
        for r, z in zip(run, zero, strict=True):
            shift = np.stack([-r[:, first], z - r[:, first]], axis=2).reshape(len(r), -1)
            left.append(r[:, 1:] + np.repeat(shift, halves, axis=1))
            between.append(r[:, first + negative] - r[:, first] + z)
        gain, apart = self._gains(left), self._gains(between)
        own = np.zeros(len(some), bool)  # columns with cells in the bin of zero: those go left with the rows without the column
        low = first + negative
        own[negative < sizes] = bins[low[negative < sizes]] == 0
        apart[:, own] = -1.0
        if tried is not None:
            here = tried[:, some]
            apart[~here] = -1.0
            gain[~np.repeat(here, sizes, axis=1)] = -1.0
        column = block.column[some]
        at, zero_at = gain.argmax(axis=1), apart.argmax(axis=1)
        of = np.searchsorted(first, at, "right") - 1
        for k, best in enumerate(self.found):
            for g, c, b in ((gain[k, at[k]], column[of[k]], bins[at[k]]), (apart[k, zero_at[k]], column[zero_at[k]], 0)):
                if best.better(float(g), int(c), int(b)):
                    best.gain, best.column, best.bin, best.block = float(g), int(c), int(b), block


def read_columns(row: tuple) -> Columns:
    return Columns(*[np.frombuffer(x, kind) for x, kind in zip(row, (np.int64, np.int64, np.int32, np.int64), strict=True)])


@dataclass
class Held:
    """Train rows for fits whose driver and tasks know a few numbers of every row: blocks of columns, ids and labels by number."""

    blocks: RDD
    cuts: DataFrame
    width: int
    row: np.ndarray
    label: np.ndarray
    shared: Broadcast

    def release(self) -> None:
        self.blocks.unpersist()
        self.shared.destroy()


def _column_blocks(rows: DataFrame, extent: Extent, max_bins: int) -> Held:
    """The cells of a part of the columns meet in one task, which finds the boundaries and keeps them as a block."""
    spark = rows.sparkSession
    width, cells, parts = extent.width, extent.cells, extent.parts
    table = rows.select("row", "label").toArrow()  # bounded: the caller has counted the rows
    row, label = (np.asarray(table.column(c).combine_chunks()) for c in ("row", "label"))
    order = np.argsort(row, kind="stable")
    row, label = row[order].astype(np.int64), label[order].astype(np.float64)
    partition, first = np.unique(row >> 33, return_index=True)
    firsts = dict(zip(partition.tolist(), first.tolist(), strict=True))
    packed = rows.select("row", "label", "features").mapInArrow(Packing(cells, parts, firsts).run, _PIECES)
    binned = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(ColumnBinning(max_bins).run, _COLUMNS)
    found = stage(binned, "columns")
    cuts = found.select("column", "cut").mapInArrow(_listed_cuts, "column int, cuts array<double>")
    cores = spark.sparkContext.defaultParallelism
    blocks = found.select("codes", "starts", "at", "first").repartition(cores).rdd.map(lambda r: tuple(map(bytes, r)))
    return Held(blocks.persist(StorageLevel.MEMORY_AND_DISK), cuts, width, row, label, spark.sparkContext.broadcast((row, label)))


@dataclass(frozen=True)
class Splitting:
    """What tasks need to split a level over blocks of columns: the growth, the shared rows, their nodes and the round's numbers."""

    growth: Growth
    shared: Broadcast
    node: Broadcast
    given: Broadcast | None
    min_rows: float
    first: int = 0

    def run(self, blocks: Iterator[tuple]) -> Iterator[tuple]:
        """Per tree and node the best split of the task's columns: gain, column, bin, statistics of both sides, rows going right."""
        row, label = self.shared.value
        target, live = self.growth.target, self.growth.live
        given = None if self.given is None else self.given.value
        node = self.node.value
        held = [read_columns(x) for x in blocks]
        for t in range(len(node)):
            nodes = np.flatnonzero(live[t])
            if not len(nodes):
                continue
            weight, value = target.drawn(self.first + t, row, label, given)
            level = Level(node[t], nodes, weight, value, target.n_labels, target.gini, self.min_rows)
            for block in held:
                tried = None
                if self.growth.share < 1:
                    tried = _uniform(self.first + t, nodes[:, None], block.column[None, :], self.growth.seed) < self.growth.share
                level.search(block, tried)
            yield from self._splits(t, level)

    def _splits(self, t: int, level: Level) -> Iterator[tuple]:
        target, node = self.growth.target, self.node.value[t]
        for i, (k, best) in enumerate(zip(level.nodes, level.found, strict=True)):
            here = level.place == i
            whole = target.statistics(np.flatnonzero(here), level.weight, level.value)
            if best.block is None:
                yield t, int(k), -2.0, 1, 0, whole, np.zeros_like(whole), b""
                continue
            # sums of cells: the rows without the column are on the other side; a cell that comes twice counts twice
            cells = best.block.sides(best.column, best.bin)[int(best.bin >= 0)]
            some = target.statistics(cells[here[cells]], level.weight, level.value)
            left, right = (whole - some, some) if best.bin >= 0 else (some, whole - some)
            goes = best.block.right(best.column, best.bin, len(node))[node == k]
            yield t, int(k), best.gain, -best.column, -best.bin, left, right, np.packbits(goes).tobytes()


def grow_held(
    held: Held, target: ClassCounts | Residuals, n_trees: int, depth: int, share: float = 1.0, seed: int = 42, min_rows: float = 1.0,
    given: np.ndarray | None = None,
) -> tuple[Trees, np.ndarray]:
    """As ``grow``, over blocks of columns, and the node in which each row ends; ``given`` are numbers of the rows for the target.

    More trees than ``NODES_SENT`` allows grow one lot after the other.
    """
    together = max(1, NODES_SENT // max(len(held.row), 1))
    numbers = None if given is None else held.blocks.context.broadcast(given)
    lots = [_grown(held, target, min(together, n_trees - i), i, depth, share, seed, min_rows, numbers) for i in range(0, n_trees, together)]
    if numbers is not None:
        numbers.destroy()
    return _joined([trees for trees, _ in lots]), np.concatenate([node for _, node in lots])


def _grown(held: Held, target, n_trees: int, first: int, depth: int, share: float, seed: int, min_rows: float, given) -> tuple[Trees, np.ndarray]:
    trees = Trees.roots(n_trees, depth, target.n_labels if target.gini else 3)
    live = np.zeros(trees.column.shape, bool)
    live[:, 0] = True
    node = np.zeros((n_trees, len(held.row)), np.min_scalar_type(-live.shape[1]))
    for _ in range(depth):
        growth = Growth(trees, live, target, held.width, 1, share, seed)
        sent = held.blocks.context.broadcast(node)
        found: dict[tuple[int, int], tuple] = {}
        for split in held.blocks.mapPartitions(Splitting(growth, held.shared, sent, given, min_rows, first).run).collect():
            found[split[:2]] = max(found.get(split[:2], split), split, key=lambda x: x[2:5])
        sent.destroy()
        live = np.zeros_like(live)
        for (t, k), (_, _, gain, column, last, left, right, bits) in found.items():
            trees.stats[t, k] = left + right
            if gain > 0:
                trees.column[t, k], trees.at[t, k] = -column, -last
                rows = np.flatnonzero(node[t] == k)
                goes = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(rows))
                node[t, rows] = 2 * k + 1 + goes
                for child, stats in ((2 * k + 1, left), (2 * k + 2, right)):
                    trees.stats[t, child] = stats
                    live[t, child] = True
        if not live.any():
            break
    return trees, node


# Models ----------------------------------------------------------------------------------------------


def _with_cuts(trees: Trees, cuts: DataFrame) -> Trees:
    """The trees with boundaries in place of bins; reads the boundaries of the columns they split."""
    used = sorted(set(trees.column[trees.column >= 0].tolist()))
    if not used:
        return trees
    wanted = cuts.sparkSession.createDataFrame([(c,) for c in used], "column int")
    of = {r.column: np.array(r.cuts) for r in cuts.join(F.broadcast(wanted), "column").collect()}  # one per split column
    at = trees.at.copy()
    for t, node in zip(*np.nonzero(trees.column >= 0), strict=True):
        own = of[int(trees.column[t, node])]
        at[t, node] = own[int(trees.at[t, node]) + int((own < 0).sum())]
    return replace(trees, at=at)


@dataclass
class TreeModel:
    """Fitted trees: ``transform`` adds ``prediction`` and, for classes, ``probability``.

    The trees' ``values`` (tree, node, output) are added up from ``start``; ``finish`` turns the sums of a row into
    class probabilities.
    """

    trees: Trees
    values: np.ndarray
    start: np.ndarray
    width: int
    finish: str = "sum"

    def scores(self, block: Block) -> np.ndarray:
        total = np.repeat(self.start[None, :], block.n, axis=0)
        for first in range(0, len(self.values), 16):
            own = slice(first, first + 16)
            node = block.walk(self.trees.column[own], self.trees.at[own], self.trees.depth)
            total += self.values[own][np.arange(node.shape[0])[:, None], node].sum(axis=0)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def judge(vectors: pa.Array) -> pa.Array:
            own = model.value
            row, column, value = vector_cells(vectors)
            scores = own.scores(Block(len(vectors), row, column, value, max(own.width, int(column.max(initial=0)) + 1)))
            if own.finish == "softmax":
                scores = softmax(scores.T).T
            elif own.finish == "share":
                scores = scores / np.maximum(scores.sum(axis=1, keepdims=True), 1e-300)
            flat = pa.array(scores.ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * scores.shape[1], pa.int32()), flat)

        judged = df.withColumn("_s", judge("features"))
        if self.finish == "sum":
            return judged.withColumn("prediction", F.get("_s", F.lit(0))).drop("_s")
        first: Column = F.array_position("_s", F.array_max("_s")) - 1  # ties go to the smallest class
        return judged.withColumn("prediction", first.cast("double")).withColumn("probability", array_to_vector("_s")).drop("_s")


def _prepared(train: DataFrame, label: str, max_bins: int, numbers: int | None = 1) -> tuple[Held | DataFrame, DataFrame, int]:
    """Train rows for growing, the boundaries and the width; ``numbers`` are held of each row, or of each row and class."""
    ship_package(train.sparkSession)
    rows = _stored(train, label)
    extent = _extent(rows)
    if extent.n * (numbers or int(extent.label) + 1) > ROWS_HELD:
        return _row_blocks(rows, extent, max_bins)
    held = _column_blocks(rows, extent, max_bins)
    return held, held.cuts, held.width


def _grow(rows: Held | DataFrame, width: int, target, n_trees: int, depth: int, share: float, seed: int, min_rows: float) -> Trees:
    if isinstance(rows, Held):
        return grow_held(rows, target, n_trees, depth, share, seed, min_rows)[0]
    return grow(rows, width, target, n_trees, depth, share, seed, min_rows)


def _release(rows: Held | DataFrame) -> None:
    if isinstance(rows, Held):
        rows.release()


def _sizes(vectors: pa.Array) -> pa.Array:
    return vectors.field("values").value_lengths()


def widths(vectors: pa.Array) -> pa.Array:
    sizes = np.asarray(vectors.field("size").fill_null(0), np.int64)
    return pa.array(np.maximum(sizes, np.diff(_offsets(vectors.field("values")))))


def _label_counts(rows: Held | DataFrame) -> dict[float, int]:
    """Rows of each label."""
    if isinstance(rows, Held):
        return dict(zip(*(x.tolist() for x in np.unique(rows.label, return_counts=True)), strict=True))
    return {r.label: r.n for r in _labels(rows).groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one per class


def _labels(rows: DataFrame) -> DataFrame:
    """``(label, n)`` per block and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, n = np.unique(np.frombuffer(batch.column("label")[i].as_buffer(), np.float64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(n.astype(np.int64))], ["label", "n"])

    return rows.select("label").mapInArrow(run, "label double, n long")


def _n_classes(rows: Held | DataFrame) -> int:
    if isinstance(rows, Held):
        return int(rows.label.max(initial=0)) + 1
    return int(_labels(rows).agg(F.coalesce(F.max("label"), F.lit(0.0))).first()[0]) + 1


def tree_classifier(train: DataFrame, max_depth: int = 5, max_bins: int = 32, min_rows: int = 1, label: str = "label") -> TreeModel:
    """One tree by Gini impurity."""
    return forest_classifier(train, 1, max_depth, max_bins, min_rows, label, bootstrap=False, share=1.0)


def forest_classifier(
    train: DataFrame, n_trees: int = 100, max_depth: int = 5, max_bins: int = 32, min_rows: int = 1, label: str = "label",
    bootstrap: bool = True, share: float | None = None, seed: int = 42,
) -> TreeModel:
    """Trees on bootstrap rows, each node trying the root of the occurring columns; class shares are averaged."""
    rows, cuts, width = _prepared(train, label, max_bins)
    share = 1 / math.sqrt(max(cuts.count(), 1)) if share is None else share
    target = ClassCounts(_n_classes(rows), seed, bootstrap)
    trees = _grow(rows, width, target, n_trees, max_depth, share, seed, min_rows)
    _release(rows)
    shares = trees.stats / np.maximum(trees.stats.sum(axis=2, keepdims=True), 1e-300)
    return TreeModel(_with_cuts(trees, cuts), shares, np.zeros(target.n_classes), width, "share")


@dataclass(frozen=True)
class _Means(Residuals):
    """Residuals of a single tree or forest: the labels themselves, rows drawn as often as their hash says."""

    seed: int = 42
    bootstrap: bool = False

    def parts(self, block, row, label, margin, n_trees):
        for t in range(n_trees):
            weight = np.ones(block.n)
            if self.bootstrap:
                weight = np.searchsorted(_POISSON, _uniform(row, t, self.seed)).astype(np.float64)
            yield weight > 0, np.zeros(block.n, np.int64), np.stack([weight, weight * label, weight])

    def drawn(self, t: int, row: np.ndarray, label: np.ndarray, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if not self.bootstrap:
            return np.ones(len(row)), label
        return np.searchsorted(_POISSON, _uniform(row, t, self.seed)).astype(np.float64), label


def tree_regression(train: DataFrame, max_depth: int = 5, max_bins: int = 32, min_rows: int = 1, label: str = "label") -> TreeModel:
    """One tree by variance."""
    return forest_regression(train, 1, max_depth, max_bins, min_rows, label, bootstrap=False, share=1.0)


def forest_regression(
    train: DataFrame, n_trees: int = 100, max_depth: int = 5, max_bins: int = 32, min_rows: int = 1, label: str = "label",
    bootstrap: bool = True, share: float = 1 / 3, seed: int = 42,
) -> TreeModel:
    """Trees on bootstrap rows, each node trying a third of the columns; predictions are averaged."""
    rows, cuts, width = _prepared(train, label, max_bins)
    trees = _grow(rows, width, _Means(np.zeros(1), False, (), seed, bootstrap), n_trees, max_depth, share, seed, min_rows)
    _release(rows)
    means = np.divide(trees.stats[..., 1], trees.stats[..., 0], out=np.zeros(trees.column.shape), where=trees.stats[..., 0] > 0)
    return TreeModel(_with_cuts(trees, cuts), means[..., None] / n_trees, np.zeros(1), width)


def _boosted(train, rounds, max_depth, learning_rate, max_bins, min_rows, label, classes, refresh) -> TreeModel:
    rows, cuts, width = _prepared(train, label, max_bins, None if classes else 1)
    if classes:
        counts = {int(k): n for k, n in _label_counts(rows).items()}
        outputs = max(counts, default=0) + 1
        total = max(sum(counts.values()), 1)
        start = np.log(np.array([max(counts.get(k, 0), 1e-9) for k in range(outputs)]) / total)
    else:
        outputs, start = 1, np.array([train.agg(F.coalesce(F.avg(label), F.lit(0.0))).first()[0]])
    target, made = Residuals(start, classes), []
    held = isinstance(rows, Held)
    score = np.repeat(start[:, None], len(rows.label), axis=1) if held else None
    for turn in range(rounds):
        if held:
            trees, node = grow_held(rows, target, outputs, max_depth, min_rows=min_rows, given=_residuals(rows.label, score, classes))
        else:
            trees = grow(rows, width, target, outputs, max_depth, min_rows=min_rows)
        top, low = trees.stats[..., 1], trees.stats[..., 2]
        step = np.divide(top, low, out=np.zeros_like(top), where=low > 1e-12) * ((outputs - 1) / outputs if classes else 1.0)
        if not np.abs(step).max(initial=0) > 0:
            break
        made.append((trees, learning_rate * step))
        if held:
            for own, amount, ends in zip(score, made[-1][1], node, strict=True):
                own += amount[ends]
            continue
        target = replace(target, since=(*target.since, made[-1]))
        if len(target.since) >= refresh and turn + 1 < rounds:
            rows, target = stage(_rescored(rows, target, width), "binned"), replace(target, since=())
    _release(rows)
    size = 2 ** (max_depth + 1) - 1
    every = Trees(
        max_depth, *[np.concatenate([getattr(t, x) for t, _ in made] or [np.full((0, size), -1)]) for x in ("column", "at")],
        np.zeros((0, size, 3)),
    )
    values = np.zeros((len(every.column), size, outputs))
    for i, (_, step) in enumerate(made):
        for k in range(outputs):
            values[i * outputs + k, :, k] = step[k]
    return TreeModel(_with_cuts(every, cuts), values, start, width, "softmax" if classes else "sum")


def _residuals(label: np.ndarray, score: np.ndarray, classes: bool) -> np.ndarray:
    """What each tree of a round is fitted to."""
    return (label[None, :] == np.arange(len(score))[:, None]) - softmax(score) if classes else label - score


def _rescored(rows: DataFrame, target: Residuals, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for i in range(batch.num_rows):
                block, _, _, margin = read_block(batch, i, width)
                scores.append(np.ascontiguousarray(target.scores(block, margin).T).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(scores, pa.binary()))

    return rows.mapInArrow(run, _BLOCKS)


def boosted_classifier(
    train: DataFrame, rounds: int = 100, max_depth: int = 3, learning_rate: float = 0.1, max_bins: int = 32, min_rows: int = 1,
    label: str = "label", refresh: int = REFRESH,
) -> TreeModel:
    """Gradient boosting of the multinomial deviance: a round's trees, one per class, share every pass over the data."""
    return _boosted(train, rounds, max_depth, learning_rate, max_bins, min_rows, label, True, refresh)


def boosted_regression(
    train: DataFrame, rounds: int = 100, max_depth: int = 3, learning_rate: float = 0.1, max_bins: int = 32, min_rows: int = 1,
    label: str = "label", refresh: int = REFRESH,
) -> TreeModel:
    """Gradient boosting of the squared error."""
    return _boosted(train, rounds, max_depth, learning_rate, max_bins, min_rows, label, False, refresh)


def ada_boost(
    train: DataFrame, rounds: int = 50, learning_rate: float = 1.0, max_depth: int = 1, max_bins: int = 32, label: str = "label"
) -> TreeModel:
    """Boosted trees with SAMME reweighting (Zhu et al., "Multi-class AdaBoost", 2009).

    A round is one job per level: a tree's error follows from the sums of its leaves, and tasks weigh rows by the
    trees before. Predictions are the classes with the largest sum of amounts.
    """
    rows, cuts, width = _prepared(train, label, max_bins)
    n_classes = _n_classes(rows)
    made: list[Trees] = []
    amounts: list[float] = []
    held = isinstance(rows, Held)
    missed = np.zeros(len(rows.label)) if held else None  # amounts of the trees that miss a row
    for _ in range(rounds):
        if held:
            trees, node = grow_held(rows, ClassCounts(n_classes), 1, max_depth, given=np.exp(missed - sum(amounts) / 2))
        else:
            votes = (_joined(made), np.array(amounts)) if made else None
            trees = grow(rows, width, ClassCounts(n_classes, votes=votes), 1, max_depth)
        leaves = (trees.column[0] < 0) & (trees.stats[0].sum(axis=1) > 0)
        total = trees.stats[0][leaves].sum()
        error = (total - trees.stats[0][leaves].max(axis=1).sum()) / total if total else 1.0
        if error <= 1e-12:
            made.append(trees)
            amounts.append(1.0)
            break
        if error >= 1.0 - 1.0 / n_classes - 1e-12:
            break
        made.append(trees)
        amounts.append(learning_rate * (math.log((1 - error) / error) + math.log(n_classes - 1)))
        if held:
            missed += amounts[-1] * (trees.stats[0].argmax(axis=1)[node[0]] != rows.label)
    _release(rows)
    if not made:
        raise ValueError("the first tree is no better than chance")
    every = _joined(made)
    winner = every.stats.argmax(axis=2)
    values = (winner[..., None] == np.arange(n_classes)) * np.array(amounts)[:, None, None]
    return TreeModel(_with_cuts(every, cuts), values, np.zeros(n_classes), width, "share")


def _joined(made: list[Trees]) -> Trees:
    return Trees(made[0].depth, *[np.concatenate([getattr(t, x) for t in made]) for x in ("column", "at", "stats")])
