"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.llm.common import prepare, slices, stage, texts_as_bytes

SEPARATORS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("covered", T.ArrayType(_SPAN)),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)

BLOCK_BYTES = 8 << 20
"""Benchmark text that a task holds at once. A larger benchmark is matched in several blocks, each against all documents."""


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters beyond ASCII, digits and letters a to z, after A-Z are lower-cased."""
    return (text or b"").translate(SEPARATORS).split()


class TestSuffixes:
    """The windows of test items, packed and in order; each test suffix starts with one of them."""

    def __init__(self, items: list[tuple[int, bytes | None]], size: int):
        self.size = size
        words = [(i, words_of(t)) for i, t in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, x in words for w in x}), 1)}
        by_length: dict[int, tuple[list, list]] = {}
        for item, found in words:
            if not found:
                continue
            ids = np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found))
            length = min(size, len(ids))
            rows, owners = by_length.setdefault(length, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, length))
            owners.append(np.full(len(ids) - length + 1, item, np.int64))
        self.groups = []  # of equal length: the distinct windows, and where the items of each begin
        for length, (rows, owners) in sorted(by_length.items()):
            keys, owner = pack_words(np.concatenate(rows)), np.concatenate(owners)
            order = np.lexsort((owner, keys))
            distinct, first = np.unique(keys[order], return_index=True)
            self.groups.append((length, distinct, np.append(first, len(owner)), owner[order]))
        self.shortest = self.groups[0][0] if self.groups else 0


def pack_words(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows (NumPy pads with zeros when it compares)."""
    packed = np.ascontiguousarray(rows.astype(">u4"))
    return packed.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes of ``words`` in order, compared over ``depth`` words, with their sorted packed keys."""
    padded = np.concatenate([words, np.zeros(depth, words.dtype)])
    rows = padded[starts[:, None] + np.arange(depth)]
    order = np.lexsort(rows.T[::-1])
    return starts[order], pack_words(rows[order])


def _search(keys: np.ndarray, wanted: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: first and one past the last suffix that starts with each wanted window of ``length`` words."""
    kind = f"S{4 * depth}"
    raw = np.frombuffer(wanted.astype(f"S{4 * length}").tobytes(), np.uint8).reshape(len(wanted), 4 * length)
    last = np.full((len(wanted), 4 * depth), 255, np.uint8)
    last[:, : 4 * length] = raw
    return np.searchsorted(keys, wanted.astype(kind), "left"), np.searchsorted(keys, last.view(kind).ravel(), "right")


def match_shard(suffixes: TestSuffixes, texts: list[bytes | None]) -> list[tuple[int, list[dict], list[int]]]:
    """For each text its words, the word spans of its longest verbatim matches, and the items matched.

    The shard's suffix array holds the suffixes a test window can match: those that begin with enough words
    of the test vocabulary in a row. Every test suffix is binary-searched in it; neighbouring hits merge
    into the longest match.
    """
    number, counts, parts = suffixes.vocabulary, [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter((number.get(w, 0) for w in words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    bounds = np.cumsum([0, *[c + 1 for c in counts]])
    stops = np.flatnonzero(stream == 0)
    place = np.flatnonzero(stream)
    run = stops[np.searchsorted(stops, place)] - place if len(place) else place
    items: list[set[int]] = [set() for _ in texts]
    edge = np.zeros(len(stream) + 1, np.int32)
    if suffixes.groups:
        starts = place[run >= suffixes.shortest]
        order, keys = suffix_array(stream, starts, suffixes.size)
        for length, wanted, first, owner in suffixes.groups:
            low, high = _search(keys, wanted, length, suffixes.size)
            for k in np.flatnonzero(high > low):
                at = order[low[k] : high[k]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                for d in np.unique(np.searchsorted(bounds, at, "right") - 1):
                    items[d].update(owner[first[k] : first[k + 1]].tolist())
    covered = np.cumsum(edge[:-1]) > 0
    found = []
    for d, n in enumerate(counts):
        own = np.concatenate([[False], covered[bounds[d] : bounds[d] + n], [False]])
        change = np.flatnonzero(own[1:] != own[:-1])
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]
        found.append((n, spans, sorted(items[d])))
    return found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``covered`` (spans of words inside a verbatim match) and ``items`` (ids, sorted).

    A window is ``size`` consecutive words of an item, or the whole of a shorter item. Benchmark items
    come to the tasks in blocks of at most about ``block_bytes``; with more than one block, the documents
    are staged once and matched with each in turn, and the blocks' finds of a row are merged. Documents are
    never shuffled for one block.

    Null and empty texts have no words and match nothing; items without words or with a null id do not
    count; repeated rows and ids are matched row by row. Columns of ``docs`` named like the three new ones
    are replaced.
    """
    spark = prepare(docs)
    new = ("n_words", "covered", "items")
    items = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("t")).where(
        "id IS NOT NULL AND t IS NOT NULL"
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes) if total else 1
    keep = [c for c in docs.columns if c not in new]
    plain = docs.select(*[F.col(f"`{c}`") for c in keep])

    def one_block(frame: DataFrame, block: int) -> tuple[DataFrame, Broadcast]:
        own = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r.id, r.t.encode()) for r in own.collect()])  # at most about block_bytes
        columns = frame.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            suffixes = TestSuffixes(shared.value, size)
            for batch in slices(batches, text):
                found = match_shard(suffixes, texts_as_bytes(batch.column(columns.index(text))))
                n, spans, ids = zip(*found, strict=True)
                kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))
                added = [pa.array(c, k) for c, k in zip((n, spans, ids), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, *new])

        return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *_FOUND.fields])), shared

    if blocks == 1:
        return one_block(plain, 0)[0]
    number = "_row"
    while number in keep:
        number += "_"
    rows = stage(plain.withColumn(number, F.monotonically_increasing_id()), "documents")
    parts = []
    for block in range(blocks):
        found, shared = one_block(rows.select(number, text), block)
        parts.append(stage(found.drop(text), "block"))
        shared.destroy()  # the driver and the tasks hold one block at a time
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list("covered")))
    merged = every.groupBy(number).agg(  # one row per block and document
        F.max("n_words").alias("n_words"),
        F.aggregate(
            spans,
            F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)"),
            lambda out, x: F.when(
                (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
                F.concat(
                    F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                    F.array(
                        F.struct(
                            F.element_at(out, -1)["start"].alias("start"),
                            F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(F.concat(out, F.array(x))),
        ).alias("covered"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.join(merged, number).select(*[F.col(f"`{c}`") for c in keep], *new)
