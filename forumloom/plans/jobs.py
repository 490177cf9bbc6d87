"""The end-to-end jobs: collect, tally, preprocess, extract, train."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.operators import clean, columns, features, metrics, models, normalizing, split, tally, tokens
from forumloom.operators.features import Terms
from forumloom.operators.normalizing import Step
from forumloom.schema import FORUM, KEY, TEXT
from forumloom.session import cut
from forumloom.sources import readers, versions, writers


def full_normalization(stop_words: DataFrame | list[str] | None = None, lemmas: DataFrame | None = None) -> Step:
    """Every text step, then stop words, then (if a table ``token, lemma`` is given) lemmas."""

    def step(df: DataFrame, text: str = TEXT) -> DataFrame:
        df = normalizing.normalize_text(df, text)
        df = tokens.remove_stop_words(df, stop_words, text)
        return df if lemmas is None else tokens.map_tokens(df, lemmas, text=text)

    return step


STEPS: Mapping[str, Step] = {
    "accents": normalizing.remove_accents,
    "case": normalizing.lower_case,
    "everything": full_normalization(),
    "markup": normalizing.remove_markup,
    "passthrough": normalizing.passthrough,
    "stemmer": lambda df, text=TEXT: tokens.porter_stem(df, text=text),
    "stop_words": lambda df, text=TEXT: tokens.remove_stop_words(df, text=text),
}


def steps_named(names: Sequence[str]) -> Step:
    unknown = [n for n in names if n not in STEPS]
    if unknown:
        raise KeyError(f"unknown steps {unknown}; choose from {', '.join(sorted(STEPS))}")
    return normalizing.in_order(*[STEPS[n] for n in names])


def collect_comments(
    raw: DataFrame, target: str, names: dict[str, str] | None = None, versioned: bool = False
) -> None:
    """Fetched comment rows to the stored table: project, clean, de-duplicate, merge.

    A ``versioned`` target shows the whole update at once, and is read by ``versions.read_versioned``.
    """
    comments = clean.clean(clean.project_comments(raw, names))
    if versioned:
        versions.upsert_versioned(cut(comments), target)
    else:
        writers.upsert_comments(comments, target)


def tally_comments(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    """The formatted counts per forum, and the null counts per column."""
    comments = readers.read_comments(spark, where)
    return tally.report(comments), tally.null_counts(comments)


def preprocess(
    spark: SparkSession,
    where: str | Sequence[str],
    target: str,
    step: Step | Sequence[str] = ("everything",),
    resume: bool = True,
    partition_by: Sequence[str] = (FORUM,),
) -> None:
    """Normalise stored comments into another table. A resumed job skips ids its output already has."""
    step = step if callable(step) else steps_named(step)
    comments = readers.read_comments(spark, where)
    exists = writers.table_exists(spark, target)
    if resume and exists:
        comments = clean.drop_done(comments, readers.read_comments(spark, target), require_rows=True)
    mode = "append" if resume else "error"
    writers.write_comments(step(comments), target, partition_by, mode)


@dataclass(frozen=True)
class Extraction:
    """Settings of ``extract``: kind is count, tfidf or hashing."""

    kind: str = "count"
    terms: Terms = Terms()
    norm: str | None = "l2"
    n_features: int = 1 << 20
    test_size: float | int | None = None
    train_size: float | int | None = None
    seed: int = 42
    scaler: str | None = None


def extract(spark: SparkSession, where: str | Sequence[str], target: str, options: Extraction = Extraction()) -> None:
    """Split, fit on train, vectorise both; write ids and features below ``target``."""
    texts = readers.read_comments(spark, where)
    ids = cut(
        split.random_split(texts.select(KEY), KEY, options.test_size, options.train_size, options.seed).where(
            F.col("split").isNotNull()
        )
    )
    marked = texts.select(KEY, TEXT).join(ids, KEY)
    train = marked.where(F.col("split") == "train")
    if options.kind == "hashing":
        vectors = features.hashed_vectors(marked, options.n_features, options.terms, norm=options.norm)
    elif options.kind in ("count", "tfidf"):
        vocabulary = features.fit_vocabulary(train, options.terms)
        make = features.count_vectors if options.kind == "count" else features.tfidf_vectors
        extra = {} if options.kind == "count" else {"norm": options.norm}
        vectors = make(marked, vocabulary, options.terms, **extra)
    else:
        raise KeyError(f"unknown extractor {options.kind!r}; choose from count, hashing, tfidf")
    vectors = vectors.join(ids, KEY)
    if options.scaler:
        fitted = features.fit_scaler(vectors.where(F.col("split") == "train"), train.count(), options.scaler)
        vectors = features.apply_scaler(vectors, fitted)
    writers.write_ids(ids, f"{target}/ids")
    writers.write_features(vectors, f"{target}/features")


def train(
    feature_table: DataFrame,
    labels: DataFrame,
    size: int,
    ids: DataFrame,
    model: str = "logistic_regression",
    label: str = FORUM,
    wanted: Sequence[tuple[str, str | None, dict]] = (("accuracy_score", None, {}), ("f1_score", "macro", {"average": "macro"})),
    target: str | None = None,
    **params,
) -> DataFrame:
    """Fit on the train features, predict the test features, and return the wanted metrics in one row.

    ``labels`` maps ids to class names; ``ids`` are the ids and splits that ``extract`` wrote, so that documents
    without a feature are fitted, predicted and scored too. Of the ``size`` columns only those that occur in train are
    fitted; the others change no prediction. With ``target`` the test predictions are stored there.
    """
    index = models.fit_label_index(labels, label)
    numbered = index.transform(labels).select(KEY, F.col("label"))

    occurring = columns.fit_columns(feature_table.where(F.col("split") == "train"))
    if occurring.width > size:
        raise ValueError(f"the features have more than {size} columns")

    def side(name: str) -> DataFrame:
        rows = feature_table.where(F.col("split") == name).drop("split")
        own = ids.where(F.col("split") == name)
        return columns.compact_vectors(rows, occurring, own).join(numbered, KEY)

    fitted = models.fit(model, side("train"), **params)
    judged = models.predict(fitted, side("test"))
    rows = judged.select(KEY, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    if "probability" in judged.columns:
        from pyspark.ml.functions import vector_to_array

        p_true = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        rows = judged.select(KEY, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), p_true.alias("p_true"))
    rows = cut(rows)
    if target:
        names = feature_table.sparkSession.createDataFrame(
            [(float(i), name) for i, name in enumerate(index.labels)], "index double, name string"
        )
        writers.write_predictions(rows.select(KEY, "y_true", "y_pred"), names, target)
    return metrics.evaluate(rows, wanted)
