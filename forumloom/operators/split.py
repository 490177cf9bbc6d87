"""Train/test splits that do not depend on row order.

Every row gets a fixed pseudo-random rank, the MD5 of seed and id. An exact split is then a threshold on
that rank: the threshold is found with a few histograms of rank prefixes, and splitting is a projection.
Ids are expected to be unique (see ``keep_first``); rows that share an id always land on the same side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumloom.operators.order import with_positions
from forumloom.schema import KEY

DEFAULT_TEST_SIZE = 0.25
_DIGITS = 4  # hex digits per histogram: at most 65,536 counts per pass
_FIRST, _LAST = "", "g"  # compare below and above every hex string


def rank_of(key: str = KEY, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def split_sizes(n: int, test_size: float | int | None = None, train_size: float | int | None = None) -> tuple[int, int]:
    """``(n_train, n_test)``. Shares: test rounds up, train rounds down; integers are absolute counts."""

    def share(size):
        return Fraction(str(size)) * n

    n_test = None if test_size is None else test_size if isinstance(test_size, int) else math.ceil(share(test_size))
    n_train = None if train_size is None else train_size if isinstance(train_size, int) else math.floor(share(train_size))
    if n_test is None and n_train is None:
        n_test = math.ceil(share(DEFAULT_TEST_SIZE))
    if n_test is None:
        n_test = n - n_train
    if n_train is None:
        n_train = n - n_test
    if n_train < 0 or n_test < 0 or n_train + n_test > n:
        raise ValueError(f"cannot take {n_train} train and {n_test} test rows out of {n}")
    return n_train, n_test


def smallest_ranks(df: DataFrame, rank: Column, wanted: int) -> str:
    """The exclusive upper bound below which exactly ``wanted`` ranks lie (ties stay together)."""
    if wanted <= 0:
        return _FIRST
    ranks = df.select(rank.alias("_rank"))
    prefix, below = "", 0
    while len(prefix) < 32:
        width = len(prefix) + _DIGITS
        counts = (
            ranks.where(F.col("_rank").startswith(prefix))
            .groupBy(F.substring("_rank", 1, width).alias("_prefix"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        upto = Window.orderBy("_prefix")  # over at most 65,536 counts
        reached = counts.withColumn("_upto", F.sum("_n").over(upto) + F.lit(below))
        bucket = reached.where(F.col("_upto") >= wanted).orderBy("_prefix").first()
        if bucket is None:
            return _LAST
        if bucket["_upto"] == wanted or bucket["_n"] == 1:
            return bucket["_prefix"] + _LAST
        prefix, below = bucket["_prefix"], bucket["_upto"] - bucket["_n"]
    return prefix + _LAST


def random_split(
    df: DataFrame,
    key: str = KEY,
    test_size: float | int | None = None,
    train_size: float | int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exactly the requested numbers of ``test`` and ``train`` rows, others null."""
    n = df.count()
    n_train, n_test = split_sizes(n, test_size, train_size)
    rank = rank_of(key, seed)
    test_below = smallest_ranks(df, rank, n_test)
    train_below = _LAST if n_train + n_test == n else smallest_ranks(df, rank, n_train + n_test)
    return df.withColumn(
        "split", F.when(rank < test_below, "test").when(rank < train_below, "train")
    )


def ordered_split(
    df: DataFrame,
    order: Sequence[Column | str],
    test_size: float | int | None = None,
    train_size: float | int | None = None,
) -> DataFrame:
    """The first rows in ``order`` train, the following ones test."""
    n_train, n_test = split_sizes(df.count(), test_size, train_size)
    position = F.col("_pos")
    return (
        with_positions(df, order, "_pos")
        .withColumn("split", F.when(position < n_train, "train").when(position < n_train + n_test, "test"))
        .select(*df.columns, "split")
    )


def class_allocation(counts: DataFrame, label: str, wanted: int) -> DataFrame:
    """Share ``wanted`` rows among classes in proportion, largest remainders first, ties by label."""
    total = counts.agg(F.sum("n")).scalar()
    exact = counts.withColumn("_num", F.col("n") * F.lit(wanted)).withColumn("_all", total)
    floors = exact.withColumn("_base", F.expr("_num div _all")).withColumn("_rem", F.expr("_num % _all"))
    order = Window.orderBy(F.desc("_rem"), label)  # one row per class
    ranked = floors.withColumn("_rank", F.row_number().over(order))
    left = F.lit(wanted) - F.sum("_base").over(Window.partitionBy())
    return ranked.withColumn("wanted", F.col("_base") + (F.col("_rank") <= left).cast("long")).select(label, "wanted")


def stratified_split(
    df: DataFrame, label: str, key: str = KEY, test_size: float | int | None = None, seed: int = 42
) -> DataFrame:
    """Like ``random_split`` with every class in its proportion.

    All classes refine their thresholds together: each pass counts rank prefixes per class, so a class
    with most of the rows is still only a histogram.
    """
    rank = rank_of(key, seed)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one row per class
    _, n_test = split_sizes(sum(row["n"] for row in rows), test_size)
    wanted = class_allocation(counts, label, n_test)
    # open classes: prefix to look below and number of smaller ranks already counted
    state = wanted.withColumn("_prefix", F.lit("")).withColumn("_below", F.lit(0).cast("long"))
    bounds = {row[label]: _FIRST for row in rows}
    open_rows = [tuple(row) for row in state.where("wanted > 0").collect()]
    schema = df.select(F.col(label)).schema.add("wanted", "long").add("_prefix", "string").add("_below", "long")
    ranks = df.select(label, rank.alias("_rank"))
    width = 0
    while open_rows:
        width += _DIGITS
        pending = F.broadcast(df.sparkSession.createDataFrame(open_rows, schema))  # one row per class
        counts = (
            ranks.join(pending, ranks[label].eqNullSafe(pending[label])).drop(pending[label])
            .where(F.col("_rank").startswith(F.col("_prefix")))
            .groupBy(label, "wanted", "_below", F.substring("_rank", 1, width).alias("_at"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_at")) + F.col("_below")
        reached = counts.withColumn("_upto", upto).where(F.col("_upto") >= F.col("wanted"))
        first = reached.groupBy(label, "wanted").agg(F.min(F.struct("_at", "_upto", "_n")).alias("b"))
        open_rows = []
        for row in first.collect():  # one row per class
            at, upto_value, n = row["b"]["_at"], row["b"]["_upto"], row["b"]["_n"]
            if upto_value == row["wanted"] or n == 1 or len(at) >= 32:
                bounds[row[label]] = at + _LAST
            else:
                open_rows.append((row[label], row["wanted"], at, upto_value - n))
    thresholds = df.sparkSession.createDataFrame(
        list(bounds.items()), df.select(F.col(label)).schema.add("_bound", "string")
    )
    return (
        df.join(F.broadcast(thresholds), df[label].eqNullSafe(thresholds[label]), "left")
        .drop(thresholds[label])
        .withColumn("split", F.when(rank < F.col("_bound"), "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def approximate_split(df: DataFrame, key: str = KEY, test_size: float = DEFAULT_TEST_SIZE, seed: int = 42) -> DataFrame:
    """Each row decides by its own rank, without looking at others; works on streams."""
    bound = F.lit(int(test_size * (1 << 32)))
    number = F.conv(F.substring(rank_of(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(number < bound, "test").otherwise("train"))
