"""Large tables of tokens meet chunks of rows: same rows as the broadcast form, and no row per token is shuffled."""

import pytest
from pyspark.sql import functions as F

from forumloom.operators import features, tokens

ROWS = [
    ("1", "the cat the hat", 1), ("2", "", 2), ("3", None, 3), ("4", "dog the  unknown", 4), (None, "cat", 5),
    ("1", "hat hat", 6), ("5", "  ", 7), *[(f"d{i}", f"the word{i} cat", i) for i in range(40)],
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "comment_id string, text string, n long").repartition(3)


def listed(df):
    return sorted(map(repr, df.collect()))


def test_large_mapping_travels_by_distinct_token(spark, docs, monkeypatch):
    mapping = spark.createDataFrame([("the", "THE"), ("cat", "c"), ("c", "wrong"), ("hat", None), ("word7", ""), (None, "x")], "token string, lemma string")
    want = listed(tokens.map_tokens(docs, mapping))
    monkeypatch.setattr(tokens, "MAX_MAPPING", 1)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 400)
    made, staged = [], tokens.stage
    monkeypatch.setattr(tokens, "_carried_tokens", lambda *a: pytest.fail("a row per token"))
    monkeypatch.setattr(tokens, "stage", lambda *a: made.append(staged(*a)) or made[-1])
    assert listed(tokens.map_tokens(docs, mapping)) == want
    assert len({r[0] for r in made[0].select("_chunk").collect()}) > 3


def test_large_table_of_vectors_travels_by_distinct_token(spark, docs, monkeypatch):
    vectors = spark.createDataFrame(
        [("the", [1.0, 2.0]), ("cat", [0.5, -1.0]), ("hat", [0.0, 3.0]), ("word7", [9.0, 9.0])], "token string, vector array<float>"
    )
    rounded = lambda: listed(features.document_vectors(docs, vectors).select("comment_id", F.transform("vector", lambda x: F.round(x, 9))))
    want = rounded()
    monkeypatch.setattr(features, "MAX_BROADCAST_FLOATS", 2)
    monkeypatch.setattr(features, "join_lookup", lambda *a, **k: pytest.fail("a vector per occurrence"))
    assert rounded() == want
