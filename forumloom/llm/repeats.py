"""Substring dedup: seeds from winnowed anchors; whole windows around shared seeds joined, runs of hits merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumloom.llm.common import WordHashes, mix, prepare, slices, stage, texts_as_bytes

SEED_WORDS = 4
LAST = np.iinfo(np.int64).max
"""Stands for a null id: later than all others."""

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` words, from prefix sums of a polynomial modulo 2^64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)])
    return mix((sums[size:] - sums[:n]) * _powers(inverse, n))


class Shard:
    """The documents of a shard as one stream of words, with the windows of ``size`` words inside documents."""

    def __init__(self, ids: list[int], sizes: list[int], blob: bytes, hashes: WordHashes, size: int):
        text = zstandard.ZstdDecompressor().decompress(blob)
        ends = np.cumsum([0, *sizes])
        self.words = [text[a:b].split() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.ids, self.size = np.array(ids, np.int64), size
        counts = np.array([len(w) for w in self.words], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.stream = mix(hashes.of([w for x in self.words for w in x]))
        owner = np.repeat(np.arange(len(counts)), counts)
        n = max(len(owner) - size + 1, 0)
        self.starts = np.flatnonzero(owner[:n] == owner[len(owner) - n :]) if n else np.zeros(0, np.int64)
        self.doc = self.ids[owner[self.starts]] if n else self.starts

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The seed chosen in each window: its place and its hash (the smallest seed of the window, the last on ties)."""
        grams, n = rolling(self.stream, SEED_WORDS, _BASES[0]), max(len(self.stream) - self.size + 1, 0)
        if not n:
            return np.zeros(0, np.int64), grams
        best, place = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, self.size - SEED_WORDS + 1):
            lower = grams[j : j + n] <= best
            best[lower] = grams[j : j + n][lower]
            place[lower] = j
        return (np.arange(n) + place)[self.starts], best[self.starts]

    def windows(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, together 128 bits, of the (chosen) windows."""
        at = self.starts if chosen is None else self.starts[chosen]
        return tuple(rolling(self.stream, self.size, b)[at] if len(self.stream) >= self.size else at.astype(np.uint64) for b in _BASES)


def least_by(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and the smallest and largest document of each."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, docs, docs
    return keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def shards(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents packed into rows of about 4 MB of text, compressed, and staged: later passes see the same shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, deflate = TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, text):
            texts = [t or b"" for t in texts_as_bytes(batch.column(text))]
            ids = [LAST if i is None else i for i in batch.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([deflate.compress(b"".join(texts))], pa.binary()),
                ],
                names=["shard", "ids", "sizes", "blob"],
            )
            number += 1

    rows = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        run, "shard long, ids array<long>, sizes array<long>, blob binary"
    )
    return stage(rows, "shards")


def _per_shard(function, names: list[str], kinds: list[pa.DataType], size: int):
    """A ``mapInArrow`` function that builds each shard and yields the columns ``function`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                shard = Shard(row["ids"].as_py(), row["sizes"].as_py(), row["blob"].as_py(), hashes, size)
                told = row["told"].values if "told" in row and row["told"].is_valid else None
                told = told.to_numpy(zero_copy_only=False).astype(np.int64) if told is not None else np.zeros(0, np.int64)
                for columns in function(shard, row["shard"].as_py(), np.sort(told.view(np.uint64))):
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _told(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with what was found for each shard; a shard's list is no longer than its words."""
    lists = found.groupBy("shard").agg(F.collect_list("found").alias("told"))
    return rows.join(lists, "shard", "left")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13) -> DataFrame:
    """``(doc_id, n_words, repeats, kept_text)``: documents without the words that repeat an earlier document.

    A word goes if a window of ``size`` consecutive words that covers it also occurs in a document with
    a smaller id; ``repeats`` are the maximal runs of such words as ``(start, end)``. ``kept_text`` joins the rest with
    a blank.

    Winnowing picks in each window one seed of ``SEED_WORDS`` words that depends on its words alone, so equal
    windows have equal seeds. Seeds are joined across documents; only around seeds that several
    documents share are the windows themselves extended from the seed to both sides and joined, for the
    first document that has them. Each shard of documents posts a seed or window once, with its smallest id,
    so a passage in every document costs a row per shard, and pairs of documents are never formed.

    Null and empty texts have no words. Null ids count as later than all others and alike; repeated ids are not
    earlier than each other, and each row is judged. An empty table gives no rows; other columns are ignored.
    """
    if size < SEED_WORDS:
        raise ValueError(f"a window needs {SEED_WORDS} words at least")
    prepare(docs)
    rows = shards(docs, key, text)

    def post_seeds(shard: Shard, number: int, _told):
        _, seeds = shard.anchors()
        seeds = np.unique(seeds)
        for i in range(0, len(seeds), 100_000):
            part = seeds[i : i + 100_000]
            yield part.view(np.int64), np.full(len(part), number)

    seeds = rows.mapInArrow(_per_shard(post_seeds, ["found", "shard"], [pa.int64(), pa.int64()], size), "found long, shard long")
    shared = seeds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("found"))).where("n > 1").drop("n")

    def post_windows(shard: Shard, number: int, told: np.ndarray):
        _, seeds = shard.anchors()
        names, least, most = least_by(seeds, shard.doc)
        chosen = among(seeds, told) | among(seeds, names[least < most])
        first, second = shard.windows(chosen)
        doc = shard.doc[chosen]
        order = np.lexsort((doc, first))
        first, second, doc = first[order], second[order], doc[order]
        new = np.concatenate([[True], first[1:] != first[:-1]]) if len(first) else np.zeros(0, bool)
        first, second, doc = first[new], second[new], doc[new]
        for i in range(0, len(first), 100_000):
            part = slice(i, i + 100_000)
            yield first[part].view(np.int64), second[part].view(np.int64), doc[part], np.full(len(doc[part]), number)

    windows = _told(shared, rows).mapInArrow(
        _per_shard(post_windows, ["found", "check", "doc", "shard"], [pa.int64()] * 4, size),
        "found long, check long, doc long, shard long",
    )
    earliest = F.min("doc").over(Window.partitionBy("found", "check"))
    later = windows.withColumn("earliest", earliest).where("earliest < doc").select("shard", "found")

    def keep(shard: Shard, _number: int, told: np.ndarray):
        found, _ = shard.windows()
        names, least, most = least_by(found, shard.doc)
        several = least < most
        gone = among(found, told)
        here = np.flatnonzero(among(found, names[several]))
        gone[here] |= shard.doc[here] > least[np.searchsorted(names, found[here])]
        edge = np.zeros(len(shard.stream) + 1, np.int32)
        np.add.at(edge, shard.starts[gone], 1)
        np.add.at(edge, shard.starts[gone] + shard.size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out = [], [], [], []
        for d, words in enumerate(shard.words):
            own = covered[shard.bounds[d] : shard.bounds[d + 1]]
            spans = []
            if own.any():
                change = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]
                words = [w for w, c in zip(words, own, strict=True) if not c]
            ident = int(shard.ids[d])
            for column, value in zip(out, (None if ident == LAST else ident, len(own), spans, b" ".join(words)), strict=True):
                column.append(value)
        ids, n, spans, kept = out
        yield ids, n, spans, pa.array(kept, pa.binary()).cast(pa.string())

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return _told(later, rows).mapInArrow(
        _per_shard(keep, ["doc_id", "n_words", "repeats", "kept_text"], [pa.int64(), pa.int64(), spans, pa.string()], size),
        "doc_id long, n_words long, repeats array<struct<start:bigint,end:bigint>>, kept_text string",
    )
