"""The registered learners run with the operators' own defaults."""

import inspect

import pytest

from workload import learning_queries as queries
from workload.registry import QUERIES

BOUNDED = ("t9_",)
LEARNERS = [n for n in QUERIES if n.startswith(("t2_", "t3_", "t4_", "t5_", "t6_", "t10_", "t11_", "t12_", "t13_", "t14_", *BOUNDED))]
CHOSEN = {"t3_sgd_log_loss": {"loss": "log_loss"}}


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", LEARNERS)
def test_learners_keep_the_defaults(spark, monkeypatch, name):
    default, seen = inspect.signature(queries._labelled).parameters["width"].default, {}
    rows = spark.createDataFrame([("1", 0.0, 3.0, "train")], "comment_id string, label double, n_chars double, split string")

    def labelled(spark, folder, width=default, norm="l2"):
        seen["width"] = width
        return rows

    def fit(name, train, regression=False, **params):
        seen["params"] = params
        raise Fitted

    monkeypatch.setattr(queries, "_labelled", labelled)
    monkeypatch.setattr(queries.models, "fit", fit)
    with pytest.raises(Fitted):
        QUERIES[name](spark, "")
    assert seen == {"width": queries.BOUNDED_WIDTH if name.startswith(BOUNDED) else 1 << 20, "params": CHOSEN.get(name, {})}
