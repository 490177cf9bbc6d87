"""Ranked lexical search: item tiles times document tiles as dense float64 products that stay exact."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumloom.llm.common import prepare, slices, stage, texts_as_bytes

BLOCK_BYTES = 8 << 20
"""Item text whose terms are with the driver and the tasks at once; more items take more passes."""

PIECE_BYTES = 1 << 20
"""Text split into words at once; longer texts are split piece by piece, at ends of words."""

DOC_TILE, ITEM_TILE, TERM_TILE = 512, 256, 4096
EXACT = 1 << 53
LARGEST_IMPACT = 1_000_000
"""Above every impact: (10^9 tf) div (1000 tf + 20 m) with m > 0."""

SALTS = 32

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: bytes | None, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of at most about ``piece`` bytes (one longer term is one list)."""
    data = (text or b"").translate(_TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + piece)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass(frozen=True)
class Tile:
    """Items that are multiplied together, over the terms that occur in them alone.

    ``terms`` are sorted codes; cell k says that item ``item[k]`` has the term ``terms[place[k]]``.
    """

    rows: np.ndarray
    terms: np.ndarray
    place: np.ndarray
    item: np.ndarray


class ItemBlock:
    """Codes of the distinct terms of some items, and the items in tiles."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        words = sorted({w for _, terms in items for w in terms})
        self.codes = {w.encode(): i for i, w in enumerate(words)}
        number = {w: i for i, w in enumerate(words)}
        self.tiles = []
        for first in range(0, len(items), ITEM_TILE):
            own = items[first : first + ITEM_TILE]
            code = np.array([number[w] for _, terms in own for w in terms], np.int64)
            item = np.repeat(np.arange(len(own)), [len(terms) for _, terms in own])
            terms, place = np.unique(code, return_inverse=True)
            self.tiles.append(Tile(np.array([r for r, _ in own], np.int64), terms, place, item))


def term_cells(texts: list[bytes | None], codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each text in terms, and ``(text, code, tf)`` of the coded terms in it, sorted."""
    lengths, parts = np.zeros(len(texts), np.int64), []
    width = max(len(codes), 1)
    for d, text in enumerate(texts):
        for words in words_of(text):
            lengths[d] += len(words)
            found = np.fromiter(map(codes.get, words, itertools.repeat(-1)), np.int64, len(words))
            parts.append(found[found >= 0] + d * width)
    cells, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
    return lengths, cells // width, cells % width, tf


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; products beyond 64 bits are taken as big integers."""
    small = 50 * int(lengths.max(initial=0)) * n_docs < 1 << 63 and int(tf.max(initial=0)) < 1 << 33
    kind = np.int64 if small else object
    m = 50 + (50 * lengths.astype(kind) * n_docs) // max(n_terms, 1)
    tf = tf.astype(kind)
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.float64)


def tile_scores(
    tile: Tile, weights: np.ndarray, n: int, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, term_tile: int = TERM_TILE
) -> np.ndarray:
    """Scores of ``n`` documents by the tile's items, as int64.

    Each product adds so few terms that no partial sum reaches 2^53, so float64 is exact in whatever order the
    library adds; the sums of term tiles meet in 64-bit integers.
    """
    total = np.zeros((n, len(tile.rows)), np.int64)
    largest = int(weights[tile.terms].max(initial=0)) * LARGEST_IMPACT
    step = max(1, min(term_tile, (EXACT - 1) // max(largest, 1)))
    at = np.searchsorted(tile.terms, code)
    known = at < len(tile.terms)
    known[known] = tile.terms[at[known]] == code[known]
    doc, at, impact = doc[known], at[known], impact[known]
    for low in range(0, len(tile.terms), step):
        width = min(step, len(tile.terms) - low)
        ours, theirs = (at >= low) & (at < low + width), (tile.place >= low) & (tile.place < low + width)
        left, right = np.zeros((n, width)), np.zeros((width, len(tile.rows)))
        left[doc[ours], at[ours] - low] = impact[ours]
        place = tile.place[theirs]
        right[place - low, tile.item[theirs]] = weights[tile.terms[place]]
        total += (left @ right).astype(np.int64)
    return total


class Best:
    """The ``top`` best documents of each item of a tile so far; equal scores go by ascending id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)  # ties with the last place stay in until ids decide
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        doc, null = np.concatenate([self.doc, doc[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.floor)))
        rank = np.arange(len(order)) - first[item[order]]
        order, last = order[rank < self.top], order[rank == self.top - 1]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        self.floor[item[last]] = score[last]


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    top: int = 50,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` best documents of each item: ``(item_key, rank, key, score)``, rank from 1.

    Terms are runs of ASCII letters, digits and characters above 127, A-Z lower-cased. Items come in blocks whose
    texts have about ``block_bytes``; the driver holds the distinct terms of one block (one item is never
    divided) and their document frequencies. Two passes over the documents per block, the first of which also
    counts documents and terms, and no shuffle of documents: each task multiplies tiles and keeps its ``top`` best
    of each item, which meet in two rounds of ranking.

    Null and empty texts and texts without a term are not counted and never found; an item without a term has no
    rows, and neither have empty tables. Each row of ``items`` is an item and each row of ``docs`` a document, also
    where ids repeat or are null; of equal scores null ids come last. Other columns of both are ignored.
    """
    spark = prepare(docs)
    docs = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    items = items.select(F.col(item_key).alias("_id"), F.col(item_text).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            terms = [
                sorted({w.decode("utf-8", "replace") for words in words_of(t) for w in words})
                for t in texts_as_bytes(batch.column("_text"))
            ]
            terms = pa.array(terms, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("_item"), terms], names=["_item", "terms"])

    numbered = stage(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    terms = stage(numbered.select("_item", "_text").mapInArrow(split, "_item long, terms array<string>"), "item-terms")
    bytes_ = F.aggregate("terms", F.lit(0).cast("long"), lambda total, w: total + F.octet_length(w))
    total = terms.agg(F.coalesce(F.sum(bytes_), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))

    def statistics(block: ItemBlock) -> tuple[int, int, np.ndarray]:
        shared = spark.sparkContext.broadcast(block.codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = shared.value
            total = np.zeros(len(codes) + 2, np.int64)  # frequencies, then documents and terms
            for batch in slices(batches, "_text"):
                lengths, _, code, _ = term_cells(texts_as_bytes(batch.column("_text")), codes)
                total[:-2] += np.bincount(code, minlength=len(codes))
                total[-2:] += (np.count_nonzero(lengths), lengths.sum())
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["code", "n"])

        counted = docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        found = np.zeros(len(block.codes) + 2, np.int64)
        for code, n in counted.collect():  # one row per term of the block
            found[code] = n
        shared.destroy()
        return int(found[-2]), int(found[-1]), found[:-2]

    def candidates(block: ItemBlock) -> DataFrame:
        n_docs, n_terms, frequency = statistics(block)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()]
        shared = spark.sparkContext.broadcast((block, np.array(weights, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, weights = shared.value
            best = [Best(len(tile.rows), top) for tile in block.tiles]
            for batch in slices(batches, "_text"):
                lengths, doc, code, tf = term_cells(texts_as_bytes(batch.column("_text")), block.codes)
                impact = impacts(tf, lengths[doc], n_docs, n_terms)
                null = np.asarray(batch.column("_doc").is_null())
                ids = np.asarray(batch.column("_doc").fill_null(0))
                for low in range(0, len(lengths), DOC_TILE):
                    high = min(low + DOC_TILE, len(lengths))
                    a, b = np.searchsorted(doc, [low, high])
                    for tile, kept in zip(block.tiles, best, strict=True):
                        scores = tile_scores(tile, weights, high - low, doc[a:b] - low, code[a:b], impact[a:b])
                        kept.add(scores, ids[low:high], null[low:high])
            for tile, kept in zip(block.tiles, best, strict=True):
                columns = [pa.array(tile.rows[kept.item]), pa.array(kept.doc, mask=kept.null), pa.array(kept.score)]
                yield pa.RecordBatch.from_arrays(columns, names=["_item", "_doc", "score"])

        found = stage(docs.mapInArrow(run, "_item long, _doc long, score long"), "candidates")
        shared.destroy()
        return found

    every = None
    for number in range(blocks):
        own = terms.where(F.size("terms") > 0)
        own = own.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == number) if blocks > 1 else own
        rows = [(r[0], r[1]) for r in own.orderBy("_item").collect()]  # about block_bytes of terms
        if rows:
            found = candidates(ItemBlock(rows))
            every = found if every is None else every.unionByName(found)
    if every is None:
        every = spark.createDataFrame([], "_item long, _doc long, score long")

    def ranked(df: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("_doc"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    salted = every.withColumn("_salt", F.pmod(F.xxhash64("_doc", "score"), F.lit(SALTS)))
    final = ranked(ranked(salted, "_item", "_salt").drop("rank", "_salt"), "_item")
    names = numbered.select("_item", F.col("_id").alias(item_key))
    return final.join(names, "_item").select(item_key, "rank", F.col("_doc").alias(key), "score")
