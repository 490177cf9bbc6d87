"""Tokenisation, stop words, lemmas, stems and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumloom.functions import charsets as cs
from forumloom.functions import porter
from forumloom.functions import tokens as K
from forumloom.operators.order import with_positions
from forumloom.operators.skew import collect_if_small, fits_broadcast, join_lookup
from forumloom.schema import FORUM, KEY, TEXT
from forumloom.session import ship_package, stage

MAX_WORD_LIST = 10_000
MAX_MAPPING, MAX_MAPPING_BYTES = 500_000, 16 << 20

CHUNK_BYTES, CHUNKS_PER_TASK = 8 << 20, 1 << 20
"""Text whose distinct tokens travel together to a large mapping, and the most such chunks of a task."""

CACHED_STEMS = 200_000
"""Stems that a task remembers; words beyond them are stemmed once a batch."""


def english_stop_words() -> list[str]:
    """Spark's own English stop-word list."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def token_rows(docs: DataFrame, key: str = KEY, text: str = TEXT) -> DataFrame:
    """One row per token: ``(key, pos, token)``; empty text gives no rows."""
    return docs.select(key, F.posexplode(K.whitespace_tokens(F.col(text))).alias("pos", "token"))


def tokens_only(docs: DataFrame, text: str = TEXT) -> DataFrame:
    """One row per token occurrence."""
    return docs.select(F.explode(K.whitespace_tokens(F.col(text))).alias("token"))


def regroup(tokens: DataFrame, key: str = KEY, pos: str = "pos", token: str = "token", text: str = TEXT) -> DataFrame:
    """Tokens back to one text per document, in position order, joined by a blank.

    Tokens of a document that still sit in one task are combined there before the shuffle, so the rows
    sent are documents rather than tokens.
    """
    ordered = F.array_sort(F.collect_list(F.struct(pos, token)))
    return (
        tokens.groupBy(key).agg(ordered.alias("_t")).select(key, F.array_join(F.col(f"_t.{token}"), " ").alias(text))
    )


def remove_stop_words(
    docs: DataFrame, words: DataFrame | list[str] | None = None, text: str = TEXT, key: str = KEY
) -> DataFrame:
    """Remove stop words, ignoring case, and join the remaining tokens with one blank.

    ``words`` is a list or a table with a column ``word``; the default is Spark's English list. Up to
    ``MAX_WORD_LIST`` words become a hash set inside the projection, with no shuffle. A longer table is
    joined at token level, with the same result: one row per document, repeated ids and null words included.
    """
    if words is None:
        words = english_stop_words()
    if isinstance(words, DataFrame):
        if not fits_broadcast(words, MAX_WORD_LIST):
            return _join_words(docs, words, text)
        words = [row.word for row in words.select("word").collect()]
    words = [word for word in words if word is not None]
    return docs.withColumn(text, K.join_tokens(K.without_words(K.whitespace_tokens(F.col(text)), words)))


def _join_words(docs: DataFrame, words: DataFrame, text: str) -> DataFrame:
    tokens = _carried_tokens(docs, text).withColumn("_word", F.lower("_token"))
    listed = words.where("word IS NOT NULL").select(F.lower("word").alias("_word")).distinct()
    found = join_lookup(tokens, listed.withColumn("_stop", F.lit(True)), ["_word"], "left")
    return _texts_again(found.where("_stop IS NULL OR _pos = 0").withColumn("_keep", F.expr("_stop IS NULL AND _token <> ''")), docs, text)


def _carried_tokens(docs: DataFrame, text: str) -> DataFrame:
    """One row per token, and one for a text without tokens, each with a number of its row and the row's other columns."""
    others = [F.col(name) for name in docs.columns if name != text]
    numbered = stage(docs.select(  # written once: a retried task must not number its rows anew
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*others, F.col(text).isNotNull().alias("_has")).alias("_rest"),
        F.col(text),
    ))
    tokens = numbered.select("_row", "_rest", F.posexplode_outer(K.whitespace_tokens(F.col(text))).alias("_pos", "_token"))
    return tokens.select("_row", "_rest", F.coalesce("_pos", F.lit(0)).alias("_pos"), F.coalesce("_token", F.lit("")).alias("_token"))


def _texts_again(tokens: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The rows of ``docs`` with the kept tokens as text; missing text stays missing. One shuffle, combined before it."""
    kept = F.when(F.col("_keep"), F.struct("_pos", "_token"))
    grouped = tokens.groupBy("_row").agg(F.first("_rest").alias("_rest"), F.array_sort(F.collect_list(kept)).alias("_t"))
    value = F.when(F.col("_rest._has"), F.array_join("_t._token", " ")).alias(text)
    return grouped.select(*[value if name == text else F.col("_rest").getField(name).alias(name) for name in docs.columns])


def map_tokens(
    docs: DataFrame, mapping: DataFrame, source: str = "token", target: str = "lemma", key: str = KEY, text: str = TEXT
) -> DataFrame:
    """Replace each token by its entry in ``mapping`` (one row per token), keeping tokens without one.

    Serves lemmas and stem dictionaries alike. A mapping of checked size goes to the tasks, where the tokens of a
    batch of rows are looked up together and put back as arrays, so no row moves and no row is made per token. With a
    larger one the distinct tokens of a chunk of rows are joined, not their occurrences, and the rows of a chunk meet
    their own small mapping: a text moves once.
    """
    lookup = mapping.select(F.col(source).alias("_token"), F.col(target).alias("_to")).where("_token IS NOT NULL")
    small = collect_if_small(lookup, MAX_MAPPING, MAX_MAPPING_BYTES)
    return _map_in_rows(docs, small, text) if small is not None else _map_in_chunks(docs, lookup, text)


def _map_in_chunks(docs: DataFrame, lookup: DataFrame, text: str) -> DataFrame:
    ship_package(docs.sparkSession)
    numbered = stage(chunked(docs, text), "chunks")  # written once: a retried task must not number its rows anew
    wanted = numbered.select("_chunk", "_tokens").mapInArrow(distinct_tokens, "_chunk long, _token string")
    found = wanted.join(lookup.where("_to IS NOT NULL").dropDuplicates(["_token"]), "_token")  # a chunk names a token once: none is hot
    kind = docs.schema

    def mapped(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        known, becomes = (pairs.column(c).combine_chunks() for c in ("_token", "_to"))
        tokens = rows.column("_tokens").combine_chunks()
        new = pc.binary_join(_looked_up(tokens, known, becomes), " ")
        return pa.table([new if name == text else rows.column(name) for name in kind.names], kind.names)

    return numbered.groupBy("_chunk").cogroup(found.select("_chunk", "_token", "_to").groupBy("_chunk")).applyInArrow(mapped, kind)


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with their tokens in place of the text, and the number of a chunk of about ``CHUNK_BYTES`` of text."""

    @F.arrow_udf("long")
    def chunk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        before = TaskContext.get().partitionId() * CHUNKS_PER_TASK * CHUNK_BYTES
        for sizes in batches:
            upto = before + np.cumsum(np.asarray(sizes.fill_null(0)))
            yield pa.array(np.concatenate([[before], upto[:-1]]) // CHUNK_BYTES)
            before = int(upto[-1]) if len(upto) else before

    others = [name for name in docs.columns if name != text]
    tokens = F.when(F.col(text).isNotNull(), K.whitespace_tokens(F.col(text)))
    numbered = docs.withColumn("_chunk", chunk((F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 64).cast("long")))
    return numbered.select("_chunk", *others, tokens.alias("_tokens"))


def distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token once per chunk of a batch."""
    for batch in batches:
        chunk = np.asarray(batch.column("_chunk"))
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else []
        for begin, end in zip(starts, [*starts[1:], len(chunk)], strict=True):
            token = pc.unique(batch.column("_tokens").slice(begin, end - begin).flatten())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), chunk[begin])), token], ["_chunk", "_token"])


def _looked_up(tokens: pa.ListArray, known: pa.Array, becomes: pa.Array) -> pa.ListArray:
    """Lists of tokens with those in ``known`` replaced, missing lists kept."""
    flat = tokens.flatten()
    if len(known):
        found = becomes.take(pc.index_in(flat, value_set=known.cast(flat.type)))
        flat = pc.coalesce(found.cast(flat.type), flat)
    sizes = np.asarray(tokens.value_lengths().fill_null(0))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(np.asarray(tokens.is_null()), False))
    return pa.ListArray.from_arrays(offsets, flat)


def _map_in_rows(docs: DataFrame, mapping: pa.Table, text: str) -> DataFrame:
    known, becomes = (mapping.column(c).combine_chunks() for c in ("_token", "_to"))
    shared = docs.sparkSession.sparkContext.broadcast((known, becomes))

    @F.arrow_udf("array<string>")
    def mapped(tokens: pa.Array) -> pa.Array:
        known, becomes = shared.value
        flat = tokens.flatten()
        if len(known):
            found = becomes.take(pc.index_in(flat, value_set=known))
            flat = pc.coalesce(found.cast(flat.type), flat)
        sizes = np.asarray(tokens.value_lengths().fill_null(0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    value = F.array_join(mapped(K.whitespace_tokens(F.col(text))), " ")
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), value))


def stem_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``(token, stem)`` for the distinct tokens, by Porter's algorithm."""

    @F.pandas_udf("string")
    def porter_stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(porter.stem)

    return tokens.select(token).distinct().withColumn("stem", porter_stem(F.col(token)))


def porter_stem(docs: DataFrame, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Stem every token inside its row: nothing is shuffled, whatever the vocabulary.

    Python sees each distinct token of a batch once, and remembers up to ``CACHED_STEMS`` stems for the task.
    """

    @F.arrow_udf("array<string>")
    def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for tokens in batches:
            words = tokens.flatten().dictionary_encode()
            stems = []
            for word in words.dictionary.to_pylist():
                found = known.get(word)
                if found is None:
                    found = porter.stem(word)
                    if len(known) < CACHED_STEMS and len(word) <= 64:
                        known[word] = found
                stems.append(found)
            sizes = np.asarray(tokens.value_lengths().fill_null(0))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(stems, pa.string()).take(words.indices))

    value = F.array_join(stemmed(K.whitespace_tokens(F.col(text))), " ")
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), value))


def regex_stem(docs: DataFrame, pattern: str, min_length: int = 0, text: str = TEXT) -> DataFrame:
    stemmed = K.regex_stem(K.whitespace_tokens(F.col(text)), pattern, min_length)
    return docs.withColumn(text, K.join_tokens(stemmed))


# Punctuation marks for token annotation: every mark is a token of its own, backticks in runs.
ANNOTATION_PATTERN = rf"`+|[{cs.WORD}]+(?:['\-][{cs.WORD}]+)*|[^{cs.SPACE}{cs.WORD}]"


def annotate_tokens(docs: DataFrame, key: str = KEY, text: str = TEXT) -> DataFrame:
    """``(key, pos, text, is_punct, is_inline_code)``, one row per token.

    A backtick run opens inline code and the next one closes it; an unclosed run marks nothing. Windows
    are per document, whose tokens come from a single row.
    """
    tokens = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANNOTATION_PATTERN), F.lit(0))))
    tokens = tokens.select(key, "pos", F.col("col").alias("text"))
    tick = F.col("text").startswith("`")
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    tokens = tokens.withColumn("_seen", F.sum(tick.cast("int")).over(upto)).withColumn(
        "_total", F.sum(tick.cast("int")).over(whole)
    )
    opening = F.when(tick, F.col("_seen") - 1).otherwise(F.col("_seen"))  # runs before this token
    inside = F.when(tick, F.col("_seen") <= F.col("_total") - F.col("_total") % 2).otherwise(
        (opening % 2 == 1) & (opening < F.col("_total"))
    )
    return tokens.select(
        key,
        "pos",
        "text",
        (~F.col("text").rlike(r"[\p{L}\p{N}]")).alias("is_punct"),
        inside.alias("is_inline_code"),
    )


def drop_annotated(annotations: DataFrame, key: str = KEY) -> DataFrame:
    """Regroup the tokens that are neither punctuation nor inline code."""
    kept = annotations.where(~(F.col("is_punct") | F.col("is_inline_code")))
    return regroup(kept.withColumnRenamed("text", "token"), key)


def vocabulary(docs: DataFrame, text: str = TEXT) -> DataFrame:
    """Distinct tokens in code-point order with their 0-based index: ``(token, term_idx)``."""
    return with_positions(tokens_only(docs, text).distinct(), ["token"], "term_idx")


def vocabulary_size(docs: DataFrame, text: str = TEXT, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return tokens_only(docs, text).agg(counter("token").alias("n_tokens"))


def vocabulary_sketches(docs: DataFrame, group: str = FORUM, text: str = TEXT, log_size: int = 12) -> DataFrame:
    """``(group, sketch)``: a HyperLogLog sketch of each group's tokens, to be stored and merged later.

    Its relative standard error is about 0.8 / sqrt(2^log_size), 1.3 % by default.
    """
    tokens = docs.select(group, F.explode(K.whitespace_tokens(F.col(text))).alias("token"))
    return tokens.groupBy(group).agg(F.hll_sketch_agg("token", F.lit(log_size)).alias("sketch"))


def merged_vocabulary_size(sketches: DataFrame, *group: str) -> DataFrame:
    """Estimated distinct tokens of merged sketches, over all groups or per ``group``; no text is read again."""
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_tokens"))
