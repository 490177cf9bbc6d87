"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import learnable, prepare, slices, stage, texts_as_bytes

SEPARATORS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SAMPLE = 3000
"""Labelled documents of each class that the model learns from, the first by a hash of the id."""

WINDOW = 12
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 4096, 112640, 6
TELLING = 2048
"""Most words that mark a window of toxic text as a sample for its dictionary, those in most contexts first."""

WINDOWS, WINDOW_BYTES = 100_000, 512
"""Distinct windows a dictionary is trained on, the first by hash, and the longest of them; scoring has neither bound."""

FEATURES = ("most", "second", "mean", "share", "log_windows")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SEPARATORS).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" %s " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


class Distances:
    """What a window saves when the toxic dictionary stands before the ordinary one.

    The ordinary text of a window costs much the same either way, so that the difference is what the toxic dictionary
    alone explains; with each dictionary by itself that difference drowns in the words only one of them has.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = [self._compressor(ordinary), self._compressor(toxic + ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        plain = {
            "format": zstd.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False,
        }
        level = zstd.ZstdCompressionParameters.from_level(LEVEL, **plain)
        if not content:
            return zstd.ZstdCompressor(compression_params=level)
        made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=level)
        return zstd.ZstdCompressor(dict_data=made, compression_params=level)

    def features(self, text: bytes | None) -> list[float]:
        windows = windows_of(words_of(text))
        if not windows:
            return [0.0] * len(FEATURES)
        ordinary, toxic = (c.compress for c in self.pair)
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], float)
        top = np.sort(saved)[::-1]
        return [
            top[0], top[1] if len(top) > 1 else 0.0, saved.mean(), (saved >= 3).mean(), float(np.log1p(len(windows))),
        ]


def contexts(docs: DataFrame) -> DataFrame:
    """``(label, before, word, after)``: the distinct contexts of each word, so that copies of a document count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = set()
            for label, text in zip(batch.column("toxic").to_pylist(), texts_as_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                found.update(zip([label] * len(words), [b"", *words], words, [*words[1:], b""]))  # noqa: B905
            if found:
                label, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)],
                    names=["label", "before", "word", "after"],
                )

    kinds = "label int, before binary, word binary, after binary"
    return docs.mapInArrow(run, kinds).distinct()


def samples(docs: DataFrame, telling: frozenset[bytes]) -> DataFrame:
    """``(toxic, window)``, distinct: windows of ordinary text, and runs of the telling words of each toxic text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = set()
            for label, text in zip(batch.column("toxic").to_pylist(), texts_as_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                if label:
                    words = list(dict.fromkeys(w for w in words if w in telling))
                found.update((label, w) for w in windows_of(words) if len(w) <= WINDOW_BYTES)
            if found:
                label, window = zip(*found, strict=True)
                columns = [pa.array(label, pa.int32()), pa.array(window, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "window"])

    return docs.mapInArrow(run, "toxic int, window binary").distinct()


def dictionary(windows: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes that zstandard trains on the windows; too few to train on are taken as they are."""
    try:
        return zstd.train_dictionary(size, windows, level=LEVEL).as_bytes() if windows else b""
    except zstd.ZstdError:
        return b"".join(windows)[-size:]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn both dictionaries and the calibration from at most ``sample`` labelled documents of each class.

    The ids are drawn from the labels alone and then meet the documents as a small broadcast, so documents are
    not shuffled. Of the sample, two thirds train the dictionaries: the ordinary one on windows of ordinary text, the
    toxic one on the words of toxic text that are at least ten times as common there, as runs in their order. The last
    third calibrates a logistic score of window savings, weighted to the classes' shares among all labels.
    """
    prepare(docs)
    known = (
        labels.where(learnable(key) & F.col("toxic").isin(0, 1))
        .groupBy(F.col(key).alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id", F.lit("toxicity"))
    drawn = [known.where(F.col("toxic") == c).orderBy(order, "id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * sample rows
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(ids, "id")
    chosen = stage(chosen.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3))), "labelled")
    counts = contexts(chosen.where("part < 2").select("toxic", "text")).groupBy("word").agg(
        F.sum(F.expr("CASE WHEN label = 1 THEN 1 ELSE 0 END")).alias("t"),
        F.sum(F.expr("CASE WHEN label = 0 THEN 1 ELSE 0 END")).alias("o"),
    )
    counts = stage(counts, "contexts")
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
    least = max(3, 0.005 * chosen.where("part < 2 AND toxic = 1").count())
    telling = counts.where((F.col("t") >= least) & (F.col("t") * total.o > 10 * (F.col("o") + 0.5) * total.t))
    short = telling.where(F.octet_length("word") < WINDOW_BYTES).orderBy(F.desc("t"), "word").limit(TELLING)
    texts = stage(samples(chosen.where("part < 2").select("toxic", "text"), frozenset(bytes(r.word) for r in short.collect())))
    drawn = [
        [bytes(r.window) for r in texts.where(F.col("toxic") == c).orderBy(F.xxhash64("window"), "window").limit(WINDOWS).collect()]
        for c in (1, 0)
    ]  # at most WINDOWS * WINDOW_BYTES bytes each
    made = dictionary(drawn[0], TOXIC_BYTES), dictionary(drawn[1], ORDINARY_BYTES)
    rows = savings(chosen.where("part = 2"), *made).collect()  # at most 2 * sample rows of five numbers
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r.toxic for r in rows], float)
    weight = np.array([shares[int(c)] / max((y == c).sum(), 1) for c in y], float)
    return Model(*made, *fit_logistic(x, y, weight))


def savings(docs: DataFrame, toxic: bytes, ordinary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(toxic, ordinary)
        for batch in slices(batches, "text"):
            found = [distances.features(t) for t in texts_as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found)], names=["toxic", "features"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, features array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2):
    """Weighted logistic regression by Newton's method on standardised features; the base rate alone if a class is absent."""
    width = x.shape[1]
    centre, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    if not len(x) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return centre, scale, np.zeros(width), float(np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5)))
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weight = weight / weight.mean()
    beta, ridge = np.zeros(width + 1), np.diag([penalty * len(x)] * width + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge @ beta
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta[:-1], float(beta[-1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, likelihood of a toxic document) and ``predicted`` (1 from 0.5 on).

    A projection over whole texts in windows of ``WINDOW`` words. Null and empty texts have no window and get the score
    of no savings. Columns of ``docs`` named like the two new ones are replaced.
    """
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        distances = Distances(m.toxic, m.ordinary)
        for column in columns:
            x = np.array([distances.features(t.encode() if t else None) for t in column], float).reshape(len(column), -1)
            z = ((x - m.centre) / m.scale) @ m.weights + m.bias if len(column) else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    scored = docs.select(kept.alias("_row"), F.pandas_udf(run, "double")(F.col(text)).alias("_score"))
    return scored.select("_row.*", F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
