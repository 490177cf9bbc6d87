"""Multinomial naive Bayes over long feature tables, as joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.operators.skew import HOT_SHARE, fits_broadcast, join_lookup
from forumloom.schema import KEY


@dataclass(frozen=True)
class BayesModel:
    """``classes``: label, log_prior, base (log weight of a term never seen in the class), one row per class.
    ``weights``: one row per term with the classes that saw it and their excess over ``base``."""

    classes: DataFrame
    weights: DataFrame


def fit_bayes(
    features: DataFrame, labels: DataFrame, label: str = "label", alpha: float = 1.0, n_terms: int | None = None,
    key: str = KEY,
) -> BayesModel:
    """Empirical class priors and smoothed term likelihoods; ``n_terms`` defaults to the terms present."""
    labels = labels.select(key, label)
    priors = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_docs"))
    total_docs = priors.agg(F.sum("_docs")).scalar()
    sums = (
        features.join(labels, key)
        .groupBy(label, "term_idx")
        .agg(F.sum("value").alias("_n"))
    )
    size = F.lit(n_terms) if n_terms else features.agg(F.count_distinct("term_idx")).scalar()
    per_class = sums.groupBy(label).agg(F.sum("_n").alias("_all"))
    classes = priors.join(per_class, label, "left").select(
        label,
        F.log(F.col("_docs") / total_docs).alias("log_prior"),
        (F.log(F.lit(alpha)) - F.log(F.coalesce("_all", F.lit(0.0)) + alpha * size)).alias("base"),
    )
    excess = F.log(F.col("_n") + alpha) - F.log(F.lit(alpha))
    weights = sums.groupBy("term_idx").agg(
        F.collect_list(F.struct(F.col(label).alias("label"), excess.alias("excess"))).alias("by_class"),
        F.sum("_n").alias("_n"),
    )
    return BayesModel(classes, weights)


def bayes_scores(
    model: BayesModel, features: DataFrame, label: str = "label", key: str = KEY, ids: DataFrame | None = None
) -> DataFrame:
    """``(key, label, score)``: joint log likelihood of each document with each class.

    ``ids`` has the key of every document; one without a known term has no features and scores its priors.
    A class contributes its base weight for every term and the excess only for terms it saw, so the join
    meets each document term once and no document x term x class table is built.
    """
    table = model.weights.select("term_idx", "by_class")
    if fits_broadcast(table, 200_000):
        joined = features.join(F.broadcast(table), "term_idx", "left")
    else:
        hot = model.weights.where(F.col("_n") * HOT_SHARE > model.weights.agg(F.sum("_n")).scalar()).select("term_idx")
        joined = join_lookup(features, table, ["term_idx"], "left", hot=hot)
    seen = joined.select(
        key,
        "value",
        F.inline_outer("by_class").alias("label", "excess"),
    )
    excess = seen.where(F.col("label").isNotNull()).groupBy(key, F.col("label").alias(label)).agg(
        F.sum(F.col("value") * F.col("excess")).alias("_excess")
    )
    classes = model.classes.agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "log_prior", "base"))
    ).scalar()
    totals = features.groupBy(key).agg(F.sum("value").alias("_total"))
    if ids is not None:
        totals = ids.select(key).distinct().join(totals, key, "left").na.fill(0.0, ["_total"])
    start = totals.select(key, "_total", F.inline(classes).alias(label, "log_prior", "base"))
    return start.join(excess, [key, label], "left").select(
        key,
        label,
        (F.col("log_prior") + F.col("_total") * F.col("base") + F.coalesce("_excess", F.lit(0.0))).alias("score"),
    )


def predict_bayes(
    model: BayesModel, features: DataFrame, label: str = "label", key: str = KEY, digits: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """``(key, prediction)``: the best class, ties to the smallest label (scores compared at ``digits``)."""
    return best_classes(bayes_scores(model, features, label, key, ids), label, key, digits)


def best_classes(scores: DataFrame, label: str = "label", key: str = KEY, digits: int | None = None) -> DataFrame:
    """``(key, prediction)`` from ``(key, label, score)``."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    best = scores.groupBy(key).agg(F.min(F.struct((-score).alias("_s"), F.col(label).alias("_l"))).alias("_best"))
    return best.select(key, F.col("_best._l").alias("prediction"))
