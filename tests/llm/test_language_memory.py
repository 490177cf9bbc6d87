"""The language operator's arrays stay small and give the sums of the dense form."""

import tracemalloc

import numpy as np

from forumloom.llm import language


def test_bundles_are_exact_and_bounded():
    rng = np.random.default_rng(1)
    letters = language.letter_vectors(1024, 7)
    grams = np.sort(rng.choice(language.GRAMS, 30_000, replace=False))
    counts = rng.integers(0, 50, (6, len(grams)))
    dense = sum(
        counts[:, i : i + 1000].astype(float) @ language.gram_vectors(grams[i : i + 1000], letters).astype(float)
        for i in range(0, len(grams), 1000)
    )
    tracemalloc.start()
    found = language.bundled(counts, grams, letters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, dense)
    assert peak < 64 << 20  # all vectors at once take 120 MB, and three such arrays were made


def test_added_counts_like_a_dense_sum():
    rng = np.random.default_rng(2)
    grams, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    dense = np.zeros(500, np.int64)
    for size in (0, 300, 1, 1000, 0):
        more = rng.integers(0, 500, size).astype(np.int32)
        grams, n = language.added(grams, n, more)
        dense += np.bincount(more, minlength=500)
    assert np.array_equal(grams, np.flatnonzero(dense)) and np.array_equal(n, dense[grams])
