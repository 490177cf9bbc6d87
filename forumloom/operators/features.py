"""Feature tables in long form: ``(comment_id, term_idx, value)``.

Counting happens inside each row (sort the row's terms, measure the runs), so documents turn into
``(document, term, count)`` rows without a shuffle. Only joins to a large vocabulary and norms that need
whole documents move rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.functions import tokens as K
from forumloom.operators.order import with_positions
from forumloom.operators.skew import HOT_SHARE, collect_if_small, fits_broadcast, join_lookup
from forumloom.operators.tokens import chunked, distinct_tokens
from forumloom.schema import KEY, TEXT
from forumloom.session import ship_package, stage

MAX_BROADCAST_TERMS = 500_000
MAX_BROADCAST_FLOATS = 20_000_000
MAX_BROADCAST_BYTES = 32 << 20

TERMS_AT_ONCE = 1 << 20
"""Terms of a batch that are hashed together; one longer text is handled alone."""

CACHED_DIGESTS = 200_000
"""Terms whose digest a task remembers; terms beyond them are digested once a batch."""


@dataclass(frozen=True)
class Terms:
    """How a text becomes terms, and which terms are kept; defaults as in common count vectorisers."""

    analyzer: str = "word"
    ngram_range: tuple[int, int] = (1, 1)
    lowercase: bool = True
    strip_accents: bool = False
    stop_words: Sequence[str] = ()
    token_pattern: str = K.DEFAULT_TOKEN_PATTERN
    binary: bool = False
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None
    vocabulary: Sequence[str] = field(default=())

    def of(self, text: Column) -> Column:
        low, high = self.ngram_range
        if self.analyzer == "word":
            tokens = K.word_tokens(text, self.token_pattern, self.lowercase, self.strip_accents, list(self.stop_words))
            return K.word_ngrams(tokens, low, high)
        if self.analyzer == "char":
            return K.char_ngrams(text, low, high, self.lowercase, self.strip_accents)
        if self.analyzer == "char_wb":
            return K.word_bounded_char_ngrams(text, low, high, self.lowercase, self.strip_accents)
        raise ValueError(f"unknown analyzer: {self.analyzer}")


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: ``table`` has ``term, term_idx, doc_freq``; ``n_docs`` counts the fitted rows."""

    table: DataFrame
    n_docs: int


def _term_arrays(docs: DataFrame, terms: Terms, key: str | Sequence[str], text: str) -> DataFrame:
    """``(key, _terms)``. Word tokens are bound to a column first: n-grams mention them several times."""
    keys = [key] if isinstance(key, str) else list(key)
    if terms.analyzer == "word" and terms.ngram_range != (1, 1):
        single = K.word_tokens(
            F.col(text), terms.token_pattern, terms.lowercase, terms.strip_accents, list(terms.stop_words)
        )
        tokens = docs.select(*keys, single.alias("_tokens"))
        return tokens.select(*keys, K.word_ngrams(F.col("_tokens"), *terms.ngram_range).alias("_terms"))
    return docs.select(*keys, terms.of(F.col(text)).alias("_terms"))


def _run_starts(values: Column, same: Column | None = None) -> Column:
    """Indexes at which a new run begins in a sorted array; ``same`` maps an element to its run key."""
    part = same or (lambda x: x)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0) | (part(F.get(values, i)) != part(F.get(values, i - 1))),
    )
    return F.when(F.size(values) > 0, starts).otherwise(F.array().cast("array<int>"))


def term_bags(docs: DataFrame, terms: Terms = Terms(), key: str = KEY, text: str = TEXT) -> DataFrame:
    """``(key, bag)``: the distinct terms of each document with their counts, as one array per row."""
    arrays = _term_arrays(docs, terms, key, text).select(key, F.sort_array("_terms").alias("_s"))
    starts = arrays.select(key, "_s", _run_starts(F.col("_s")).alias("_starts"))
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_s"))
    count = (lambda i, j: F.lit(1)) if terms.binary else (lambda i, j: end(j) - i)
    bag = F.transform(
        "_starts", lambda i, j: F.struct(F.get("_s", i).alias("term"), count(i, j).cast("long").alias("n"))
    )
    return starts.select(key, bag.alias("bag"))


def term_counts(docs: DataFrame, terms: Terms = Terms(), key: str = KEY, text: str = TEXT) -> DataFrame:
    """``(key, term, n)`` over all terms of every document, without a shuffle."""
    # the outer form: a plain ``inline`` (or a filter on the array's size) makes the optimizer push a filter
    # below the projections, which repeats the counting for every element
    return term_bags(docs, terms, key, text).select(key, F.inline_outer("bag")).where(F.col("term").isNotNull())


def term_totals(docs: DataFrame, terms: Terms = Terms(), text: str = TEXT) -> DataFrame:
    """``(term, n, docs)``: occurrences of each term and the rows that hold it.

    Python counts the terms of up to ``TERMS_AT_ONCE`` at a time, so what is shuffled is one row per distinct term of
    such a part, not one per term and document.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n = 0
        for batch in batches:
            lists = batch.column("_terms")
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
            start = 0
            while start < len(lists):
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + TERMS_AT_ONCE - n, "right")))
                held.append(lists.slice(start, end - start))
                n += int(ends[end - 1] - before)
                start = end
                if n >= TERMS_AT_ONCE or start < len(lists):
                    yield _totals(held, terms.binary)
                    held, n = [], 0
        if held:
            yield _totals(held, terms.binary)

    parts = _term_arrays(docs, terms, (), text).mapInArrow(run, "term string, n long, docs long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _totals(lists: list[pa.Array], binary: bool) -> pa.RecordBatch:
    """The distinct terms of some rows, how often they occur and in how many rows."""
    some = pa.concat_arrays(lists)
    words = some.flatten().dictionary_encode()
    there = np.asarray(words.indices.is_valid())
    row = np.repeat(np.arange(len(some)), np.asarray(some.value_lengths().fill_null(0), np.int64))[there]
    place, size = np.asarray(words.indices.drop_null(), np.int64), len(words.dictionary)
    pairs = np.sort(row * size + place)
    own = pairs[np.append(True, pairs[1:] != pairs[:-1])] % size if len(pairs) else pairs
    rows = np.bincount(own, minlength=size)
    count = rows if binary else np.bincount(place, minlength=size)
    return pa.RecordBatch.from_arrays([words.dictionary, pa.array(count), pa.array(rows)], ["term", "n", "docs"])


def _bound(limit: int | float, n_docs: int) -> float:
    return limit if isinstance(limit, int) else limit * n_docs


def fit_vocabulary(docs: DataFrame, terms: Terms = Terms(), key: str = KEY, text: str = TEXT) -> Vocabulary:
    """Document frequencies, pruning, and alphabetical term indexes.

    Each task first sums its own documents, so what is shuffled is one row per task and term.
    """
    n_docs = docs.count()
    if terms.vocabulary:
        fixed = sorted(set(terms.vocabulary))
        table = docs.sparkSession.createDataFrame(list(zip(fixed, range(len(fixed)))), "term string, term_idx long")
        frequencies = term_counts(docs, terms, key, text)
        frequencies = frequencies.where(F.col("term").isin(fixed)).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
        table = table.join(frequencies, "term", "left").fillna(0, ["doc_freq"])
        return Vocabulary(table, n_docs)
    counts = (
        term_counts(docs, terms, key, text)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("total"))
    )
    low, high = _bound(terms.min_df, n_docs), _bound(terms.max_df, n_docs)
    if high < low:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    kept = counts.where((F.col("doc_freq") >= low) & (F.col("doc_freq") <= high))
    if terms.max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(terms.max_features)
    return Vocabulary(with_positions(kept.select("term", "doc_freq"), ["term"], "term_idx"), n_docs)


def _join_terms(pairs: DataFrame, vocabulary: Vocabulary, extra: Sequence[Column] = ()) -> DataFrame:
    """Attach vocabulary columns to ``(key, term, n)``; terms outside the vocabulary drop out.

    A vocabulary of checked size is broadcast. A larger one is shuffled with its frequent terms spread
    out; they are known from the document frequencies, at most ``HOT_SHARE`` of them.
    """
    table = vocabulary.table.select("term", "term_idx", *extra)
    if fits_broadcast(table, MAX_BROADCAST_TERMS):
        return pairs.join(F.broadcast(table), "term")
    total = vocabulary.table.agg(F.sum("doc_freq")).scalar()
    hot = vocabulary.table.where(F.col("doc_freq") * HOT_SHARE > total).select("term")
    return join_lookup(pairs, table, ["term"], hot=hot)


def count_vectors(
    docs: DataFrame, vocabulary: Vocabulary, terms: Terms = Terms(), key: str = KEY, text: str = TEXT
) -> DataFrame:
    """Term counts over a fitted vocabulary."""
    pairs = term_counts(docs, terms, key, text)
    return _join_terms(pairs, vocabulary).select(key, "term_idx", F.col("n").cast("double").alias("value"))


def idf_value(doc_freq: Column, n_docs: Column | int, smooth: bool = True) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    if smooth:
        return F.log((n + 1) / (doc_freq + 1)) + 1
    return F.log(n / doc_freq) + 1


def normalize_rows(vectors: DataFrame, norm: str | None = "l2", key: str = KEY, value: str = "value") -> DataFrame:
    """Scale each document to unit length. One document's entries meet in one shuffle."""
    if norm is None:
        return vectors
    document = Window.partitionBy(key)
    if norm == "l2":
        length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(document))
    elif norm == "l1":
        length = F.sum(F.abs(value)).over(document)
    else:
        raise ValueError(f"unknown norm: {norm}")
    return (
        vectors.withColumn("_length", length)
        .withColumn(value, F.when(F.col("_length") == 0, F.col(value)).otherwise(F.col(value) / F.col("_length")))
        .drop("_length")
    )


def _term_frequency(value: Column, sublinear: bool) -> Column:
    return F.log(value) + 1 if sublinear else value


def tfidf_transform(
    counts: DataFrame,
    fit_counts: DataFrame | None = None,
    n_docs: int | None = None,
    norm: str | None = "l2",
    use_idf: bool = True,
    smooth_idf: bool = True,
    sublinear_tf: bool = False,
    key: str = KEY,
) -> DataFrame:
    """Weight count vectors; document frequencies come from ``fit_counts`` (default: the counts themselves).

    ``n_docs`` is the number of fitted documents, including those without any term.
    """
    weighted = counts.withColumn("value", _term_frequency(F.col("value"), sublinear_tf))
    if use_idf:
        fitted = fit_counts if fit_counts is not None else counts
        if n_docs is None:
            n_docs = fitted.select(key).distinct().count()
        frequencies = fitted.where(F.col("value") != 0).groupBy("term_idx").agg(F.count(F.lit(1)).alias("_df"))
        idf = frequencies.select("term_idx", "_df", idf_value(F.col("_df"), n_docs, smooth_idf).alias("_idf"))
        if fits_broadcast(idf, MAX_BROADCAST_TERMS):
            joined = weighted.join(F.broadcast(idf), "term_idx", "left")
        else:
            hot = frequencies.where(F.col("_df") * HOT_SHARE > frequencies.agg(F.sum("_df")).scalar())
            joined = join_lookup(weighted, idf, ["term_idx"], "left", hot=hot.select("term_idx"))
        # a term never seen while fitting has document frequency zero
        unseen = idf_value(F.lit(0), n_docs, True) if smooth_idf else F.lit(None)
        weighted = joined.withColumn("value", F.col("value") * F.coalesce("_idf", unseen)).select(key, "term_idx", "value")
    return normalize_rows(weighted, norm, key)


def tfidf_vectors(
    docs: DataFrame,
    vocabulary: Vocabulary,
    terms: Terms = Terms(),
    norm: str | None = "l2",
    use_idf: bool = True,
    smooth_idf: bool = True,
    sublinear_tf: bool = False,
    key: str = KEY,
    text: str = TEXT,
) -> DataFrame:
    """Tf-idf from text: the vocabulary already carries the document frequencies, so one join does it.

    A vocabulary of checked size goes to the tasks, which look up the terms of a batch of documents together; weights
    and norm are made inside the row, so nothing is shuffled. With a larger one the cells are joined, and meet
    again for the norm.
    """
    weight = idf_value(F.col("doc_freq"), vocabulary.n_docs, smooth_idf) if use_idf else F.lit(1.0)
    table = vocabulary.table.select("term", "term_idx", weight.cast("double").alias("weight"))
    small = collect_if_small(table, MAX_BROADCAST_TERMS, MAX_BROADCAST_BYTES)
    if small is not None:
        return _weighted_in_rows(term_bags(docs, terms, key, text), small, norm, sublinear_tf, key)
    pairs = _join_terms(term_counts(docs, terms, key, text), vocabulary, [weight.alias("_idf")])
    value = _term_frequency(F.col("n").cast("double"), sublinear_tf) * F.col("_idf")
    return normalize_rows(pairs.select(key, "term_idx", value.alias("value")), norm, key)


def _weighted_in_rows(bags: DataFrame, vocabulary: pa.Table, norm: str | None, sublinear: bool, key: str) -> DataFrame:
    if norm not in (None, "l1", "l2"):
        raise ValueError(f"unknown norm: {norm}")
    columns = [vocabulary.column(c).combine_chunks() for c in ("term", "term_idx", "weight")]
    shared = bags.sparkSession.sparkContext.broadcast(columns)

    @F.arrow_udf("array<struct<term_idx:bigint,value:double>>")
    def weighted(bag: pa.Array) -> pa.Array:
        term, index, weight = shared.value
        flat, sizes = bag.flatten(), np.asarray(bag.value_lengths().fill_null(0), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.asarray(pc.index_in(flat.field("term"), value_set=term).fill_null(-1), np.int64)
        there = place >= 0
        row, place = row[there], place[there]
        value = np.asarray(flat.field("n"), np.float64)[there]
        value = (np.log(value) + 1 if sublinear else value) * np.asarray(weight, np.float64)[place]
        if norm is not None:
            length = np.bincount(row, value * value if norm == "l2" else np.abs(value), len(sizes))
            length = np.sqrt(length) if norm == "l2" else length
            value = value / np.where(length == 0, 1.0, length)[row]
        cells = pa.StructArray.from_arrays([pa.array(np.asarray(index, np.int64)[place]), pa.array(value)], ["term_idx", "value"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cells)

    cells = bags.select(key, weighted("bag").alias("_v"))
    return cells.select(key, F.inline_outer("_v")).where(F.col("term_idx").isNotNull())


def hashed_vectors(
    docs: DataFrame,
    n_features: int = 1 << 20,
    terms: Terms = Terms(),
    alternate_sign: bool = True,
    norm: str | None = "l2",
    key: str = KEY,
    text: str = TEXT,
) -> DataFrame:
    """Hashed term counts of fixed width. No vocabulary and no shuffle, norms included; works on streams.

    The first eight hex digits of a term's MD5 give its index, the parity of the ninth its sign. Each distinct term of a
    batch of rows is digested once.
    """
    bags = hashed_bags(docs.select(key, text), n_features, terms, alternate_sign, norm, text)
    return bags.select(key, F.inline_outer("cells")).where(F.col("term_idx").isNotNull())


def hashed_bags(
    docs: DataFrame,
    n_features: int = 1 << 20,
    terms: Terms = Terms(),
    alternate_sign: bool = True,
    norm: str | None = "l2",
    text: str = TEXT,
) -> DataFrame:
    """``docs`` with its hashed cells by index, ``cells: array<term_idx, value>``, in place of the text: one row per row."""
    if norm not in (None, "l1", "l2"):
        raise KeyError(norm)
    binary = terms.binary
    ship_package(docs.sparkSession)

    @F.arrow_udf("array<struct<term_idx:bigint,value:double>>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, int]] = {}
        for lists in batches:
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
            parts: list[pa.Array] = []
            start = 0
            while start < len(lists) or not parts:  # long texts: some rows of the batch at a time
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + TERMS_AT_ONCE, "right")))
                some = lists.slice(start, end - start)
                row = np.repeat(np.arange(len(some)), np.asarray(some.value_lengths().fill_null(0), np.int64))
                parts.append(_hashed_cells(some.flatten(), row, len(some), known, n_features, alternate_sign, binary, norm))
                start = end
            yield pa.concat_arrays(parts)

    others = [name for name in docs.columns if name != text]
    return _term_arrays(docs, terms, others, text).select(*others, hashed("_terms").alias("cells"))


def _digest(term: str) -> tuple[int, int]:
    """The first eight hex digits of a term's MD5 as a number, and the sign that the ninth gives."""
    found = hashlib.md5(term.encode()).digest()
    return int.from_bytes(found[:4], "big"), 1 - 2 * (found[4] >> 4 & 1)


def _hashed_cells(
    flat: pa.Array, row: np.ndarray, n_rows: int, known: dict, n_features: int, signed: bool, binary: bool, norm: str | None
) -> pa.Array:
    """The hashed cells of each row, by index; sums of whole numbers, so equal in any order."""
    words = flat.dictionary_encode()
    pairs = []
    for word in words.dictionary.to_pylist():
        pair = known.get(word) or (_digest(word) if word is not None else (0, 0))
        if len(known) < CACHED_DIGESTS and word is not None and len(word) <= 64:
            known[word] = pair
        pairs.append(pair)
    index, sign = np.array(pairs, np.int64).reshape(-1, 2).T
    there = np.asarray(words.indices.is_valid())
    place, row = np.asarray(words.indices.drop_null(), np.int64), row[there]
    code = row * n_features + (index % n_features)[place]
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    weight = (sign[place] if signed else np.ones(len(place), np.int64))[order]
    value = np.add.reduceat(weight, starts).astype(np.float64) if len(code) else np.zeros(0)
    row, column = np.divmod(code[starts], n_features)
    kept = value != 0
    row, column, value = row[kept], column[kept], value[kept]
    if binary:
        value = np.ones(len(value))
    if norm is not None:
        length = np.bincount(row, value * value if norm == "l2" else np.abs(value), n_rows)
        value = value / (np.sqrt(length) if norm == "l2" else length)[row]
    cells = pa.StructArray.from_arrays([pa.array(column), pa.array(value)], ["term_idx", "value"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cells)


# Embeddings ------------------------------------------------------------------------------------------


def embedding_table(vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(token, term_idx, vector)`` for a vocabulary; unknown tokens get the zero vector."""
    size = vectors.agg(F.max(F.size("vector"))).scalar()
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return vocabulary.join(vectors, "token", "left").select(
        "token", "term_idx", F.coalesce(F.col("vector").cast("array<float>"), zero).alias("vector")
    )


def document_vectors(docs: DataFrame, vectors: DataFrame, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Mean of the token vectors of each document, unknown tokens counting as zeros: ``(key, vector)``.

    A document without tokens has the zero vector.

    A table of checked size is broadcast, and tokens are counted per document before they meet it. Of a larger one a
    chunk of rows gets the vectors of its distinct tokens, so vectors do not travel per occurrence.
    """
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    known = vectors.select("token", "vector")
    if not fits_broadcast(known, MAX_BROADCAST_FLOATS // width):
        return _means_in_chunks(docs.select(key, text), known, width, key, text)
    whitespace = docs.select(key, F.sort_array(K.whitespace_tokens(F.col(text))).alias("_s"))
    runs = whitespace.select(key, "_s", _run_starts(F.col("_s")).alias("_starts"))
    counts = runs.select(
        key,
        F.inline_outer(
            F.transform(
                "_starts",
                lambda i, j: F.struct(
                    F.get("_s", i).alias("token"),
                    (F.coalesce(F.get("_starts", j + 1), F.size("_s")) - i).cast("double").alias("n"),
                ),
            )
        ),
    )
    joined = counts.join(F.broadcast(known), "token", "left")
    zero = F.array_repeat(F.lit(0.0), width)
    vector = array_to_vector(F.coalesce(F.col("vector").cast("array<double>"), zero))
    summed = joined.select(key, F.coalesce("n", F.lit(1.0)).alias("n"), vector.alias("_v")).groupBy(key).agg(
        Summarizer.mean(F.col("_v"), F.col("n")).alias("_mean")
    )
    return summed.select(key, vector_to_array("_mean").alias("vector"))


def _means_in_chunks(docs: DataFrame, known: DataFrame, width: int, key: str, text: str) -> DataFrame:
    ship_package(docs.sparkSession)
    numbered = stage(chunked(docs, text), "chunks")  # written once: a retried task must not number its rows anew
    wanted = numbered.select("_chunk", "_tokens").mapInArrow(distinct_tokens, "_chunk long, _token string")
    wanted = wanted.join(known.select(F.col("token").alias("_token"), "vector"), "_token")  # a chunk names a token once: none is hot
    kind = T.StructType([docs.schema[key], T.StructField("n", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def means(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        tokens, names = rows.column("_tokens").combine_chunks(), vectors.column("_token").combine_chunks()
        sizes = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        lists = vectors.column("vector").combine_chunks()
        matrix = np.asarray(lists.flatten().fill_null(0), np.float64).reshape(-1, width)  # a name per row
        flat = tokens.flatten()
        place = np.asarray(pc.index_in(flat, value_set=names.cast(flat.type)).fill_null(-1)) if len(names) else np.full(len(flat), -1)
        out = np.zeros((len(sizes), width))
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(sizes):
            own = place[ends[i] - sizes[i] : ends[i]]
            out[i] = matrix[own[own >= 0]].sum(axis=0) / sizes[i]
        offsets = pa.array((np.arange(len(sizes) + 1) * width).astype(np.int32))
        vector = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
        return pa.table([rows.column(key), pa.array(np.maximum(sizes, 1).astype(np.float64)), vector], kind.names)

    found = numbered.groupBy("_chunk").cogroup(wanted.groupBy("_chunk")).applyInArrow(means, kind)
    whole = found.groupBy(key).agg(Summarizer.mean(array_to_vector("v"), F.col("n")).alias("_mean"))  # ids may repeat
    return whole.select(key, vector_to_array("_mean").alias("vector"))


# Scaling ---------------------------------------------------------------------------------------------


def fit_scaler(train: DataFrame, n_docs: int, kind: str = "max_abs") -> DataFrame:
    """``(term_idx, n, scale)`` from train rows; absent entries count as zeros.

    ``max_abs`` divides by the largest absolute value, ``standard`` by the population standard deviation
    (without centring, which would fill in every absent entry).
    """
    n = F.count(F.lit(1)).alias("n")
    if kind == "max_abs":
        fitted = train.groupBy("term_idx").agg(n, F.max(F.abs("value")).alias("scale"))
    elif kind == "standard":
        mean = F.sum("value") / n_docs
        square = F.sum(F.col("value") * F.col("value")) / n_docs
        fitted = train.groupBy("term_idx").agg(n, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("scale"))
    else:
        raise ValueError(f"unknown scaler: {kind}")
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def apply_scaler(features: DataFrame, scaler: DataFrame) -> DataFrame:
    """Divide by the fitted scale; columns never seen while fitting stay as they are."""
    table = scaler.select("term_idx", "scale")
    if fits_broadcast(table, MAX_BROADCAST_TERMS):
        joined = features.join(F.broadcast(table), "term_idx", "left")
    else:
        hot = scaler.where(F.col("n") * HOT_SHARE > scaler.agg(F.sum("n")).scalar()).select("term_idx")
        joined = join_lookup(features, table, ["term_idx"], "left", hot=hot)
    return joined.withColumn("value", F.col("value") / F.coalesce("scale", F.lit(1.0))).select(*features.columns)


# Estimator boundary ----------------------------------------------------------------------------------

_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vectors(
    features: DataFrame, size: int, key: str = KEY, name: str = "features", ids: DataFrame | None = None
) -> DataFrame:
    """Long features to one sparse ML vector per document; with ``ids``, an empty one for ids without features.

    The vector is read from its struct form by the JSON reader, which keeps the conversion in the JVM.
    """
    cells = features.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_idx", "value"))).alias("_c"))
    if ids is not None:
        cells = ids.select(key).join(cells, key, "left")
    form = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        F.coalesce(F.transform("_c.term_idx", lambda i: i.cast("int")), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("_c.value").cast("array<double>"), F.array().cast("array<double>")).alias("values"),
    )
    parsed = F.from_json(F.to_json(F.struct(form.alias("v"))), _VECTOR)
    return cells.select(key, parsed["v"].alias(name))
