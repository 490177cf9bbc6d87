"""Totals of terms are those of a plain count, and no row per term and document is shuffled."""

from collections import Counter

import pytest

from forumloom.operators import features
from forumloom.operators.features import Terms

TEXTS = ["a bb bb cc", "", None, "bb éé  cc dd", "xx yy " * 30, "bb"]


@pytest.mark.parametrize("at_once", [1 << 20, 5])
@pytest.mark.parametrize("terms", [Terms(ngram_range=(1, 2)), Terms(analyzer="char", ngram_range=(3, 3)),
                                   Terms(analyzer="char_wb", ngram_range=(4, 4)), Terms(binary=True)], ids=lambda t: t.analyzer)
def test_totals_equal_the_counts_per_document(spark, monkeypatch, at_once, terms):
    monkeypatch.setattr(features, "TERMS_AT_ONCE", at_once)
    docs = spark.createDataFrame([(str(i), text) for i, text in enumerate(TEXTS)], "comment_id string, text string").coalesce(1)
    wanted, rows = Counter(), Counter()
    for r in features.term_counts(docs, terms).collect():
        wanted[r.term] += r.n
        rows[r.term] += 1
    found = {r.term: (r.n, r.docs) for r in features.term_totals(docs, terms).collect()}
    assert found == {term: (n, rows[term]) for term, n in wanted.items()} and len(found) > 5


def test_few_rows_leave_a_task(spark):
    docs = spark.createDataFrame([(str(i), "aa bb cc") for i in range(500)], "comment_id string, text string").coalesce(1)
    plan = features.term_totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "inline" not in plan.lower()
