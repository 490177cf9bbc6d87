"""Scores of predictions. Everything but log loss is derived from one count per (truth, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUE, PRED = "y_true", "y_pred"


def pair_counts(predictions: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """``(y_true, y_pred, n)``: the only pass over the predictions."""
    return predictions.groupBy(F.col(true).alias(TRUE), F.col(pred).alias(PRED)).agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    return predictions.agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("accuracy"))


def confusion_matrix(
    predictions: DataFrame, normalize: str | None = None, true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """``(y_true, y_pred, value)`` for all pairs of labels, in counts or shares of truth, prediction or all."""
    counts = pair_counts(predictions, true, pred)
    labels = counts.select(F.explode(F.array(TRUE, PRED)).alias("l")).agg(F.sort_array(F.collect_set("l")).alias("ls"))
    grid = labels.select(F.explode("ls").alias(TRUE), "ls").select(TRUE, F.explode("ls").alias(PRED))
    filled = grid.join(counts, [TRUE, PRED], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    if normalize is None:
        return filled.select(TRUE, PRED, F.col("n").alias("value"))
    by = {"true": [TRUE], "pred": [PRED], "all": []}[normalize]
    total = F.sum("n").over(Window.partitionBy(*by))  # over one row per pair of labels
    return filled.select(
        TRUE, PRED, F.when(total == 0, 0.0).otherwise(F.col("n") / total).alias("value")
    )


def label_counts(predictions: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """``(label, tp, n_pred, support)``."""
    counts = pair_counts(predictions, true, pred)
    hit = F.col(TRUE) == F.col(PRED)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col(TRUE).alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("n_pred"), F.col("n").alias("support")),
                F.struct(F.col(PRED).alias("label"), F.lit(0).cast("long").alias("tp"),
                         F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("support")),
            )
        )
    )
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "support")])


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero where undefined."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _precision(tp: Column, n_pred: Column, support: Column) -> Column:
    return _ratio(tp, n_pred)


def _recall(tp: Column, n_pred: Column, support: Column) -> Column:
    return _ratio(tp, support)


def _f1(tp: Column, n_pred: Column, support: Column) -> Column:
    return _ratio(2 * tp, n_pred + support)


SCORES = {"precision": _precision, "recall": _recall, "f1": _f1}


def per_label(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    args = (F.col("tp"), F.col("n_pred"), F.col("support"))
    return counts.select("label", *[f(*args).alias(name) for name, f in SCORES.items()], "support")


def _average(name: str, average: str, pos_label=1) -> Column:
    """An aggregate over ``label_counts`` for one averaged score."""
    f = SCORES[name]
    each = f(F.col("tp"), F.col("n_pred"), F.col("support"))
    if average == "micro":
        return f(F.sum("tp"), F.sum("n_pred"), F.sum("support"))
    if average == "macro":
        return F.avg(each)
    if average == "weighted":
        return _ratio(F.sum(each * F.col("support")), F.sum("support"))
    if average == "binary":
        return F.coalesce(F.max(F.when(F.col("label") == F.lit(pos_label), each)), F.lit(0.0))
    raise ValueError(f"unknown average: {average}")


def score(
    predictions: DataFrame, name: str, average: str | None = "binary", pos_label=1, true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """One of precision, recall, f1; ``average=None`` gives one row per label."""
    counts = label_counts(predictions, true, pred)
    if average is None:
        return per_label(counts).select("label", F.col(name).alias("value"))
    return counts.agg(_average(name, average, pos_label).alias("value"))


def precision(predictions: DataFrame, **kwargs) -> DataFrame:
    return score(predictions, "precision", **kwargs)


def recall(predictions: DataFrame, **kwargs) -> DataFrame:
    return score(predictions, "recall", **kwargs)


def f1(predictions: DataFrame, **kwargs) -> DataFrame:
    return score(predictions, "f1", **kwargs)


def log_loss(predictions: DataFrame, p_true: str = "p_true", eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col(p_true), F.lit(eps)), F.lit(1 - eps))
    return predictions.agg(F.avg(-F.log(p)).alias("log_loss"))


def class_table(predictions: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    return per_label(label_counts(predictions, true, pred))


def classification_report(predictions: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """The class table followed by accuracy, macro and weighted rows: ``(row, precision, recall, f1, support)``."""
    counts = label_counts(predictions, true, pred)
    classes = per_label(counts).withColumnRenamed("label", "row").withColumn("row", F.col("row").cast("string"))
    averages = {
        name: counts.agg(
            F.lit(f"{name} avg").alias("row"), *[_average(s, name).alias(s) for s in SCORES], F.sum("support").alias("support")
        )
        for name in ("macro", "weighted")
    }
    hits = _ratio(F.sum("tp"), F.sum("support"))
    accuracy_row = counts.agg(F.lit("accuracy").alias("row"), *[hits.alias(s) for s in SCORES], F.sum("support").alias("support"))
    return classes.unionByName(accuracy_row).unionByName(averages["macro"]).unionByName(averages["weighted"])


def evaluate(
    predictions: DataFrame, metrics: Sequence[tuple[str, str | None, dict]], true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """Several averaged metrics in one row, in one pass: columns ``name_suffix`` (or just ``name``).

    Each entry is ``(name, suffix, options)`` with name accuracy_score, precision_score, recall_score,
    f1_score or log_loss; log loss needs a column ``p_true``. The confusion matrix is a table of its own.
    """
    aggregates, losses = [], []
    for name, suffix, options in metrics:
        column = f"{name}_{suffix}" if suffix else name
        if name == "accuracy_score":
            aggregates.append(_ratio(F.sum("tp"), F.sum("support")).alias(column))
        elif name == "log_loss":
            losses.append(column)
        else:
            short = name.removesuffix("_score")
            if short not in SCORES:
                raise KeyError(f"unknown metric: {name}")
            aggregates.append(
                _average(short, options.get("average", "binary"), options.get("pos_label", 1)).alias(column)
            )
    row = label_counts(predictions, true, pred).agg(*aggregates) if aggregates else None
    for column in losses:
        loss = log_loss(predictions)
        row = loss.select(F.col("log_loss").alias(column)) if row is None else row.withColumn(column, loss.scalar())
    return row
