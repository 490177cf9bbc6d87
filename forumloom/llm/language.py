"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import give_back, prepare, slices

LETTERS = 128
"""Letter codes: 0 is a gap, 1 to 26 are a to z, the others share the rest by code point."""

GRAMS = LETTERS**3
MAX_LANGUAGES = 1000

TEXT_BYTES = 1 << 20
"""Text whose letters are coded at once inside a task."""

BOUND_GRAMS = 4096
"""N-grams whose vectors are made at once."""


def letter_codes() -> np.ndarray:
    """Code of every code point: 0 unless it is a letter."""
    points = np.array([chr(i).isalpha() for i in range(0x110000)])
    codes = np.where(points, 27 + np.arange(0x110000) % (LETTERS - 27), 0).astype(np.uint8)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return codes


def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (LETTERS, dimensions))


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind three letters: the vectors are rotated by their place and multiplied."""
    first, second, third = grams // LETTERS**2, grams // LETTERS % LETTERS, grams % LETTERS
    found = np.roll(letters, 2, 1)[first]
    found *= np.roll(letters, 1, 1)[second]
    found *= letters[third]
    return found


def bundled(counts: np.ndarray, grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The n-gram vectors summed by the counts of each row, made for ``BOUND_GRAMS`` of them at a time.

    All terms are whole numbers: the parts add up to the same sums in any order as long as these stay below 2^24.
    """
    total = np.zeros((len(counts), letters.shape[1]), np.float32)
    for i in range(0, len(grams), BOUND_GRAMS):
        total += counts[:, i : i + BOUND_GRAMS].astype(np.float32) @ gram_vectors(grams[i : i + BOUND_GRAMS], letters)
    return total


def added(grams: np.ndarray, n: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, with one more of each in ``more``."""
    found, new = np.unique(more, return_counts=True)
    both = np.concatenate([grams, found])
    order = np.argsort(both, kind="stable")
    both, counts = both[order], np.concatenate([n, new])[order]
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return both[starts], np.add.reduceat(counts, starts) if len(both) else counts


def grams_of(texts: list[str | None], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams of each text and the number of the text; runs of other characters are one gap."""
    pieces = [f" {(t or '').lower()} " for t in texts]
    code = codes[np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)]
    place = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (place[1:] != place[:-1])
    code, place = code[keep].astype(np.int32), place[keep]
    grams = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
    inside = place[2:] == place[:-2]
    return grams[inside], place[:-2][inside]


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """``(lang, profile)``: the bundle of the n-gram vectors of all given texts of a language.

    Bundling is a sum, so tasks count n-grams first and one row per language, n-gram and task is shuffled.
    Rows with a null text or language teach nothing.
    """
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(letter_codes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit():
            for name, (grams, n) in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

        for batch in slices(batches, text, TEXT_BYTES):
            names = np.array(batch.column(lang).to_pylist(), dtype=object)
            texts = np.array(batch.column(text).to_pylist(), dtype=object)
            for name in set(names):
                if name not in totals and len(totals) == 8:  # bounds the memory of a task
                    yield from emit()
                    totals.clear()
                grams, _ = grams_of(list(texts[names == name]), shared.value)
                known = totals.get(name, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
                totals[name] = added(*known, grams)
        yield from emit()
        totals.clear()
        give_back()

    def bundle(frame: pd.DataFrame) -> pd.DataFrame:
        letters = letter_vectors(dimensions, seed)
        total = np.zeros(dimensions)
        for i in range(0, len(frame), BOUND_GRAMS):
            part = frame.iloc[i : i + BOUND_GRAMS]
            total += part.n.to_numpy(float) @ gram_vectors(part.gram.to_numpy(), letters)
        return pd.DataFrame({"lang": [frame.lang.iloc[0]], "profile": [total]})

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counts.groupBy("lang").applyInPandas(bundle, "lang string, profile array<double>")  # at most GRAMS rows a group


def identify(
    docs: DataFrame, profiles: DataFrame, text: str = "text", dimensions: int = 1024, seed: int = 7
) -> DataFrame:
    """Add ``lang_pred`` (the profile of largest cosine, the first by name on a tie) and ``score`` (that cosine, 0 to 1).

    A projection over whole texts. Null texts, texts without a letter, and all texts when there is no profile
    are ``und`` with score 0. Columns of ``docs`` named like the two new ones are replaced.
    """
    spark = prepare(docs)
    rows = sorted(profiles.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)  # one vector a language
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [r.lang for r in rows]
    matrix = np.array([r.profile for r in rows], np.float32).reshape(len(rows), dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((letter_codes(), matrix))

    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes, profile = shared.value
        letters = letter_vectors(dimensions, seed)
        small = np.empty(GRAMS, np.int32)

        def block(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            grams, place = grams_of(texts, codes)
            seen = np.zeros(GRAMS, bool)
            seen[grams] = True
            used = np.flatnonzero(seen)
            if not len(used) or not names:
                return ["und"] * len(texts), np.zeros(len(texts))
            small[used] = np.arange(len(used))
            counts = np.bincount(place * np.int64(len(used)) + small[grams], minlength=len(texts) * len(used))
            vectors = bundled(counts.reshape(len(texts), len(used)), used, letters)
            lengths = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ profile.T) / np.maximum(lengths, 1e-12)[:, None]
            best = cosines.argmax(1)
            known = np.bincount(place, minlength=len(texts)) > 0
            score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0)
            return [names[b] if k else "und" for b, k in zip(best, known, strict=True)], score.astype(float)

        for column in columns:
            labels, scores, part, size = [], [], [], 0
            for value in column:
                part.append(value)
                size += len(value) if value else 0
                if size > TEXT_BYTES // 2 or len(part) >= 256:
                    found = block(part)
                    labels += found[0]
                    scores.append(found[1])
                    part, size = [], 0
            if part:
                found = block(part)
                labels += found[0]
                scores.append(found[1])
            yield pd.DataFrame({"lang_pred": labels, "score": np.concatenate(scores) if scores else np.zeros(0)})
        give_back()

    guess = F.pandas_udf(predict, "lang_pred string, score double")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    found = docs.select(kept.alias("_row"), guess(F.col(text)).alias("_guess"))
    return found.select("_row.*", "_guess.lang_pred", "_guess.score")
