"""Lookups inside rows give what joins give, and move no rows."""

import math
import re

import pytest

from forumloom.functions import porter
from forumloom.operators import features, tokens

TEXTS = [("1", "dogs run dogs"), ("2", ""), ("3", None), ("3", "cats \u00a0 run"), (None, "dogs"), ("4", "unknown only"), ("5", "dogs " * 4000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(TEXTS)], "comment_id string, text string, _row int").repartition(3)


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_lemmas_inside_rows_equal_the_join(spark, docs, monkeypatch):
    pairs = [("dogs", "dog"), ("cats", "cat"), ("run", None), (None, "x"), ("only", "")]
    mapping = spark.createDataFrame(pairs, "token string, lemma string")
    plain = tokens.map_tokens(docs, mapping)
    assert exchanges(plain) == exchanges(docs) and "Generate" not in plain._jdf.queryExecution().toString()
    ours = sorted(map(tuple, plain.collect()), key=repr)
    by_row = {r[2]: r[1] for r in ours}
    assert by_row[0] == "dog run dog" and by_row[1] == "" and by_row[2] is None and by_row[3] == "cat run"
    assert by_row[5] == "unknown " and by_row[6] == " ".join(["dog"] * 4000)
    monkeypatch.setattr(tokens, "MAX_MAPPING_BYTES", 3)
    joined = sorted(map(tuple, tokens.map_tokens(docs.withColumnRenamed("_row", "n"), mapping).collect()), key=repr)
    assert joined == ours
    monkeypatch.undo()
    empty = tokens.map_tokens(docs, mapping.limit(0)).where("comment_id = '1'").first()
    assert empty.text == "dogs run dogs"


@pytest.mark.parametrize("norm, sublinear", [("l2", False), ("l1", True), (None, False)])
def test_tfidf_inside_rows_equals_the_join(spark, docs, monkeypatch, norm, sublinear):
    train = docs.where("comment_id IN ('1', '3', '5')")
    vocabulary = features.fit_vocabulary(train)
    made = features.tfidf_vectors(docs, vocabulary, norm=norm, sublinear_tf=sublinear)
    assert exchanges(made) == exchanges(docs)
    ours = sorted(((r.comment_id, r.term_idx, round(r.value, 9)) for r in made.where("comment_id IS NOT NULL").collect()), key=repr)
    monkeypatch.setattr(features, "MAX_BROADCAST_BYTES", 3)
    joined = features.tfidf_vectors(docs, vocabulary, norm=norm, sublinear_tf=sublinear).where("comment_id IS NOT NULL")
    assert sorted(((r.comment_id, r.term_idx, round(r.value, 9)) for r in joined.collect()), key=repr) == ours
    if norm == "l2":
        sums = {}
        for key, _, value in ours:
            sums[key] = sums.get(key, 0) + value * value
        assert all(math.isclose(v, 1, abs_tol=1e-6) for v in sums.values())


def test_stems_need_no_shuffle_for_large_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_MAPPING", 1)
    monkeypatch.setattr(tokens, "CACHED_STEMS", 2)
    rows = [("1", "Running  ponies\tran quickly"), ("1", "Running  ponies\tran quickly"), (None, "relational"), ("2", ""), ("3", None)]
    docs = spark.createDataFrame(rows, "comment_id string, text string")
    found = tokens.porter_stem(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = [(k, None if x is None else " ".join(porter.stem(w) for w in x.split())) for k, x in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
