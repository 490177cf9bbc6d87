"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import give_back, prepare, slices, texts_as_bytes

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)


CACHED_BYTES = 128 << 20
"""Words a Python worker remembers, by their length and about ``WORD_BYTES`` each for entry, ids and place."""

WORD_BYTES = 160


def split_words(text: bytes) -> list[bytes]:
    """Words at white space, ASCII lower-cased unless they could hold a special token."""
    if b"<|" in text:
        return [w if b"<|" in w else w.lower() for w in text.split()]
    return text.lower().split()


class Encoder:
    """Token ids of many texts, equal to encoding each text whole.

    The tokenizer lower-cases and splits at white space before it merges, so a text's ids are the ids of its
    words in turn. Before that it cuts its special tokens from the text as it stands, so words with ``<|`` keep their
    case here. A Python worker encodes each distinct word once and remembers them up to about ``cached`` bytes; words
    beyond are encoded once per slice of text.
    """

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.codes: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64), 0
        self.bytes = 0

    def _append(self, ids: list[list[int]]):
        """Add the ids of new words behind those of the words that have a code."""
        first, sizes = len(self.codes), np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.used + int(sizes.sum())
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(ids) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : end] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, end - self.used)
        self.starts[first : first + len(ids) + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        words = [split_words(t or b"") for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        known = self.codes
        new = [w for w in set(flat) if w not in known]
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        self._append([e.ids for e in found])
        n = len(known)
        known.update(zip(new, range(n, n + len(new)), strict=True))
        codes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        begins, sizes = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        costs = np.cumsum([WORD_BYTES + len(w) for w in new] or [0]) + self.bytes
        room = int(np.searchsorted(costs, self.cached, "right")) if new else 0
        self.bytes = int(costs[room - 1]) if room else self.bytes
        for word in new[room:]:
            del known[word]
        self.used = int(self.starts[len(known)])
        upto = np.cumsum([0, *map(len, words)])
        bounds = np.concatenate([[0], ends])[upto]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker; its tasks share the words it has learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def attention_cost(length, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` over the fewest sequences that can hold them all.

    Documents go in descending order of cost to the cheapest sequence that has room; what does not fit is
    cut off and waits as a shorter document. At most one cut per sequence, and less than ``capacity``
    positions stay empty in all sequences together.
    """
    total = sum(lengths)
    room = [capacity] * -(-total // capacity)
    sequences = [(0.0, s) for s in range(len(room))]
    waiting = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        negative, d, start = heapq.heappop(waiting)
        cost, s = heapq.heappop(sequences)
        n = min(-negative, room[s])
        pieces.append((d, start, n, s, capacity - room[s]))
        room[s] -= n
        if room[s]:
            heapq.heappush(sequences, (cost + attention_cost(n, linear, quadratic), s))
        if n < -negative:
            heapq.heappush(waiting, (negative + n, d, start + n))
    return pieces


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    window_tokens: int = 1 << 21,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``capacity`` tokens.

    A document is its token ids and then ``end_id``. Packing needs no shuffle: each task balances windows
    of about ``window_tokens`` tokens of its own rows, so memory is bounded, and a window leaves fewer than
    ``capacity`` positions empty. Sequence ids are unique because they start with the partition number.
    ``cost`` is the estimated attention cost of the piece.

    Null and empty texts are a document of ``end_id`` alone; null and repeated ids are separate documents, in
    input order; a text longer than any window is cut like others; an empty table gives no rows; other columns
    are ignored.
    """
    prepare(docs)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = encoder_of(path), TaskContext.get().partitionId() << 33
        keys, docs_ids, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(x) for x in docs_ids]
            pieces = balance(lengths, capacity, linear, quadratic)
            d, start, n, s, offset = np.array(pieces, np.int64).T
            crc = [zlib.crc32(docs_ids[i][a : a + k]) for i, a, k in zip(d, start, n, strict=True)]
            owners = pa.array(keys, pa.int64()).take(pa.array(d))
            cost = attention_cost(n, linear, quadratic)
            columns = [owners, start, n, crc, np.array(lengths, np.int64)[d], sequence + s, offset, cost]
            sequence += -(-sum(lengths) // capacity)
            kinds = [pa.int64()] * 7 + [pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")]
            )

        for batch in slices(batches, text):
            for k, ids in zip(batch.column(key).to_pylist(), encoder.encode(texts_as_bytes(batch.column(text))), strict=True):
                keys.append(k)
                docs_ids.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                tokens += len(ids) + 1
                if tokens >= window_tokens:
                    yield flush()
                    keys, docs_ids, tokens = [], [], 0
        if keys:
            yield flush()
            keys.clear()
            docs_ids.clear()
        give_back()

    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, PIECES)
