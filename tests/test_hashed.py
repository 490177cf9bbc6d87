"""Hashed features: each distinct term of a batch is digested once, and the cells are those of a plain count."""

import hashlib
import math
from collections import Counter

import pytest

from forumloom.operators import features
from forumloom.operators.features import Terms

ROWS = [("1", "b a bb aa bb cc dd ee bb"), ("2", ""), ("3", None), (None, "aa aa éé"), ("1", "aa bb"), ("4", "xx yy " * 50)]


def plain(text, width, signed, binary, norm):
    cells = Counter()
    for word in (text or "").split():
        if len(word) > 1:
            digest = hashlib.md5(word.encode()).hexdigest()
            cells[int(digest[:8], 16) % width] += -1 if signed and int(digest[8], 16) % 2 else 1
    cells = {k: 1.0 if binary else float(v) for k, v in cells.items() if v}
    length = {None: 1.0, "l1": sum(map(abs, cells.values())), "l2": math.sqrt(sum(v * v for v in cells.values()))}[norm]
    return sorted((k, v / length) for k, v in cells.items())


@pytest.mark.parametrize("width, signed, binary, norm", [(1 << 20, True, False, "l2"), (3, True, False, None), (4, False, True, "l1")])
def test_cells_equal_a_plain_count(spark, monkeypatch, width, signed, binary, norm):
    monkeypatch.setattr(features, "TERMS_AT_ONCE", 4)
    docs = spark.createDataFrame([(str(i), text) for i, (_, text) in enumerate(ROWS)], "comment_id string, text string").coalesce(1)
    found = features.hashed_vectors(docs, width, Terms(binary=binary), signed, norm)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()  # not per term and row
    ours = sorted((r.comment_id, r.term_idx, r.value) for r in found.collect())
    wanted = sorted((str(i), k, v) for i, (_, text) in enumerate(ROWS) for k, v in plain(text, width, signed, binary, norm))
    assert ours == wanted


def test_repeated_and_null_ids_keep_their_cells(spark):
    docs = spark.createDataFrame(ROWS, "comment_id string, text string")
    found = Counter(r.comment_id for r in features.hashed_vectors(docs, norm=None).collect())
    assert found == {"1": 7, None: 2, "4": 2}
