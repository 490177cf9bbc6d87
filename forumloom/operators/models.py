"""Classifiers and regressors: columns ``features`` and ``label`` in, ``prediction`` out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.operators.least_squares import ridge_classifier
from forumloom.operators.network import perceptron
from forumloom.operators.trees import (
    ada_boost,
    boosted_classifier,
    boosted_regression,
    forest_classifier,
    forest_regression,
    tree_classifier,
    tree_regression,
)

Model = Callable[[DataFrame], DataFrame]
"""A fitted model: adds ``prediction`` (and ``probability`` where the method has one)."""


PARALLEL = 8
"""Classes that are fitted at once where each has a model of its own."""


# Labels ----------------------------------------------------------------------------------------------


def fit_label_index(df: DataFrame, label: str, output: str = "label") -> StringIndexerModel:
    """Class numbers in alphabetical order of the names."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc").fit(df)


def class_names(index: StringIndexerModel, df: DataFrame, column: str = "prediction", output: str = "predicted") -> DataFrame:
    """Names of predicted class numbers."""
    return IndexToString(inputCol=column, outputCol=output, labels=index.labels).transform(df)


# Passes ----------------------------------------------------------------------------------------------


def few_parts(train: DataFrame) -> DataFrame:
    """``train`` in no more partitions than there are cores, joined without a shuffle.

    Each pass of Spark's solvers shuffles one dense gradient per partition, as wide as the features whatever the rows
    in it; with a partition per core that does not grow with the input.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(cores) if train.rdd.getNumPartitions() > cores else train


# Penalties -------------------------------------------------------------------------------------------


def penalty_of_c(c: float, n_rows: int) -> float:
    """Spark's ``regParam`` (per mean loss) for an inverse penalty C on the summed loss."""
    return 1.0 / (c * n_rows)


@dataclass(frozen=True)
class _Target:
    n: int
    std: float


def _target(train: DataFrame, label: str) -> _Target:
    row = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return _Target(row[0], row[1] or 1.0)


def _linear(train: DataFrame, l1: float, l2: float, label: str = "label", prediction: str = "prediction", **params):
    """Least squares with penalties l1 * |w| + l2/2 * |w|^2 per mean half squared error.

    Spark divides the penalty by the target's deviation before it splits it in two, which only the
    quadratic part notices; scaling it back gives the textbook objective.
    """
    scaled = l2 * _target(train, label).std
    total = l1 + scaled
    ratio = l1 / total if total else 0.0
    estimator = R.LinearRegression(
        labelCol=label, predictionCol=prediction, regParam=total, elasticNetParam=ratio, standardization=False, **params
    )
    return estimator.fit(few_parts(train))


# Regressors ------------------------------------------------------------------------------------------


def linear_regression(train: DataFrame, **params):
    return _linear(train, 0.0, 0.0, **params)


def ridge(train: DataFrame, alpha: float = 1.0, **params):
    """Penalty alpha * |w|^2 on the summed squared error."""
    return _linear(train, 0.0, alpha / _target(train, params.get("label", "label")).n, **params)


def lasso(train: DataFrame, alpha: float = 1.0, **params):
    """Penalty alpha * |w| on the mean half squared error."""
    return _linear(train, alpha, 0.0, **params)


def elastic_net(train: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5, **params):
    return _linear(train, alpha * l1_ratio, alpha * (1 - l1_ratio), **params)


def sgd_regression(train: DataFrame, alpha: float = 1e-4, **params):
    """Squared loss with a small quadratic penalty, solved by L-BFGS instead of random steps."""
    return _linear(train, 0.0, alpha, solver="l-bfgs", **params)


def huber_regression(train: DataFrame, epsilon: float = 1.35, alpha: float = 1e-4, **params):
    return R.LinearRegression(
        loss="huber", epsilon=epsilon, regParam=alpha, standardization=False, **params
    ).fit(few_parts(train))


# Classifiers -----------------------------------------------------------------------------------------


def logistic_regression(train: DataFrame, c: float = 1.0, **params):
    """Multinomial, quadratic penalty with inverse strength ``c``."""
    return C.LogisticRegression(
        family="multinomial", regParam=penalty_of_c(c, train.count()), standardization=False, **params
    ).fit(few_parts(train))


def linear_svm(train: DataFrame, c: float = 1.0, **params):
    """Linear support vectors, one against the rest."""
    machine = C.LinearSVC(regParam=penalty_of_c(c, train.count()), standardization=False, **params)
    return C.OneVsRest(classifier=machine, parallelism=PARALLEL).fit(few_parts(train))


def sgd_classifier(train: DataFrame, loss: str = "hinge", alpha: float = 1e-4, **params):
    """A linear classifier with hinge or log loss."""
    if loss == "hinge":
        single = C.LinearSVC(regParam=alpha, standardization=False, **params)
        return C.OneVsRest(classifier=single, parallelism=PARALLEL).fit(few_parts(train))
    if loss == "log_loss":
        single = C.LogisticRegression(regParam=alpha, standardization=False, **params)
        return C.OneVsRest(classifier=single, parallelism=PARALLEL).fit(few_parts(train))
    raise ValueError(f"unknown loss: {loss}")


CLASSIFIERS = {
    "ada_boost": ada_boost,
    "boosted_trees": boosted_classifier,
    "decision_tree": tree_classifier,
    "linear_svm": linear_svm,
    "logistic_regression": logistic_regression,
    "perceptron": perceptron,
    "random_forest": forest_classifier,
    "ridge": ridge_classifier,
    "sgd": sgd_classifier,
}

REGRESSORS = {
    "boosted_trees": boosted_regression,
    "decision_tree": tree_regression,
    "elastic_net": elastic_net,
    "huber": huber_regression,
    "lasso": lasso,
    "linear": linear_regression,
    "random_forest": forest_regression,
    "ridge": ridge,
    "sgd": sgd_regression,
}


def fit(name: str, train: DataFrame, regression: bool = False, **params):
    """Fit a model by name; the result has ``transform``."""
    registry = REGRESSORS if regression else CLASSIFIERS
    if name not in registry:
        raise KeyError(f"unknown model {name!r}; choose from {', '.join(sorted(registry))}")
    return registry[name](train, **params)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


