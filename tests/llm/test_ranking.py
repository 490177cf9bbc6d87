"""Ranked search against brute force in big integers: ties, nulls, repeats, blocks of items, tiles, long texts."""

import math
import random
import re

import numpy as np
import pytest

from forumloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=50):
    bags = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    bags = [(d, w) for d, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, words in bags:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    found = []
    for item, text in items:
        scores = []
        for d, words in bags:
            score = 0
            for w in set(TERM.findall((text or "").translate(LOWER))):
                tf = words.count(w)
                m = 50 + (50 * len(words) * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(w, 0) + 1)))
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(sorted(scores)[:top], 1):
            found.append((item, rank, None if null else d, -score))
    return sorted(found, key=repr)


def corpus(seed, n=300, words=30):
    rng = random.Random(seed)
    docs = [(i, " ".join(f"W{rng.randrange(words)}" for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(n)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (900, None), (901, ""), (902, "  .,\n"), (903, "É été 中文 w1-w2_w3")]
    docs += [(1000 + i, "w1 tie") for i in range(120)] + [(2000, "w3 " * 50_000 + "x" * 100_000)]
    items = [(i, " ".join(f"w{rng.randrange(words + 5)}" for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(40)]
    items += [(3, "w1 tie"), (3, "W1 TIE tie"), (None, "w2"), (77, None), (78, ""), (79, "été É 中文"), (80, "nowhere"), (81, "x" * 100_000)]
    return docs, items


@pytest.fixture(scope="module")
def case(spark):
    docs, items = corpus(1)
    more = "doc_id long, text string, score double, rank string, _doc long, _text string, n long"
    frame = spark.createDataFrame([(d, t, 0.5, "r", 1, "u", 2) for d, t in docs], more).repartition(3)
    wanted = spark.createDataFrame([(i, t, "z", 4) for i, t in items], "item_id long, text string, _id string, _item long")
    return docs, items, frame, wanted


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 34_000])
def test_equals_brute_force_in_one_or_many_blocks(case, block_bytes):
    docs, items, frame, wanted = case
    assert rows(ranking.rank_documents(frame, wanted, block_bytes=block_bytes)) == brute(docs, items)


def test_small_tiles_and_pieces_give_the_same(case, monkeypatch):
    docs, items, frame, wanted = case
    items_ = [(i, t) for i, t in items if t and len(t) < 1000]
    texts = [None if t is None else t.encode() for _, t in docs]
    whole = ranking.term_cells(texts, {b"w1": 0, b"w3": 1, b"tie": 2})
    words = ranking.words_of
    monkeypatch.setattr(ranking, "words_of", lambda t: words(t, 7))
    assert all((a == b).all() for a, b in zip(whole, ranking.term_cells(texts, {b"w1": 0, b"w3": 1, b"tie": 2}), strict=True))
    block = ranking.ItemBlock([(k, sorted(set(t.lower().split()))) for k, (_, t) in enumerate(items_)])
    lengths, doc, code, tf = ranking.term_cells(texts, block.codes)
    impact = ranking.impacts(tf, lengths[doc], 400, int(lengths.sum()))
    weights = np.arange(len(block.codes), dtype=np.float64) + 1
    one = ranking.tile_scores(block.tiles[0], weights, len(texts), doc, code, impact)
    assert one.any() and (one == ranking.tile_scores(block.tiles[0], weights, len(texts), doc, code, impact, 3)).all()


def test_sums_stay_exact_where_float64_would_round():
    """Weights near the largest that fit: each product adds one term only, and 64-bit integers add the rest."""
    terms = np.arange(8)
    tile = ranking.Tile(np.zeros(1, np.int64), terms, terms, np.zeros(8, np.int64))
    weights = np.full(8, float((1 << 53) // ranking.LARGEST_IMPACT))
    impact = np.full(8, 999_999.0)
    got = ranking.tile_scores(tile, weights, 1, np.zeros(8, np.int64), terms, impact)
    assert got[0, 0] == 8 * ((1 << 53) // ranking.LARGEST_IMPACT) * 999_999


def test_impacts_beyond_64_bits_are_big_integers():
    n, tf = 10**12, 10**10
    want = (10**9 * tf) // (1000 * tf + 20 * (50 + (50 * n * 10**8) // 10**15))
    assert ranking.impacts(np.array([tf]), np.array([n]), 10**8, 10**15)[0] == want


def test_empty_tables(spark, case):
    _, _, frame, wanted = case
    assert ranking.rank_documents(frame.limit(0), wanted).count() == 0
    assert ranking.rank_documents(frame, wanted.limit(0)).count() == 0


def test_top_is_a_parameter(case):
    docs, items, frame, wanted = case
    assert rows(ranking.rank_documents(frame, wanted, top=3)) == brute(docs, items, 3)
