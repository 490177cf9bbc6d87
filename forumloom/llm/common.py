"""What the training-data operators share: code shipping, staged tables, Arrow batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.session import ship_package, shared_folder, staging_path

SLICE_BYTES = 4 << 20
"""Text handled at once inside a task; one longer text is handled alone."""

CACHED_WORDS = 200_000
"""Entries of a task's word cache; words beyond it are computed each time."""


def give_back() -> None:
    """Return memory that a finished task has freed to the system: Python workers live on, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package importable in its Python workers."""
    spark = df.sparkSession
    shared_folder(spark)
    ship_package(spark)
    return spark


def stage(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: later readers and retries see the same rows.

    Partition-dependent ids are stable from here on, and a lost executor costs a read, not a recomputation.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learnable(key: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the id as text is not divisible by 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where the text column passes ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(np.diff(offsets(batch.column(text))))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column, as int64."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    found = np.frombuffer(column.buffers()[1], kind) if column.buffers()[1] is not None else np.zeros(1, kind)
    return found[column.offset : column.offset + len(column) + 1].astype(np.int64)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered for the task up to ``CACHED_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive word hashes; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_numbers(size, seed)):
        total += mix(words[i : i + n] * factor + np.uint64(i))
    return mix(total)
