"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import WordHashes, give_back, mix, odd_numbers, prepare, slices, stage, texts_as_bytes, window_hashes
from forumloom.llm.components import components
from forumloom.operators.skew import join_lookup

COORDINATES, MATCHES = 40, 17
"""A pair of similarity 0.75 has fewer than 17 of 40 equal coordinates once in about 10^6 pairs."""

LONGER, LONGER_MATCHES = 256, 158
"""Of that many coordinates, the posted ones among them, a pair that is compared in full has so many equal.
A pair of similarity 0.75 has fewer once in about 10^6 pairs; at 0.5 next to no pair has as many."""

DENSE = 64
"""Postings of more documents are compared in blocks, the others by a join; changes no result."""

BLOCK = 512
"""Documents wanted on either side of a block."""

CELL_SHINGLES = 500_000
"""Shingles wanted on either side of a full comparison, which is cut further for them."""

STAR_ROUNDS = 4
"""Most times every document of a posting meets one of it before the pairs still apart are compared; changes no result."""

WORTH = 8
"""A star round is run if that many pairs are still apart for each posted row; changes no result."""

SEED = 5


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words if there are fewer."""
    if 0 < len(words) < size:
        return window_hashes(words, len(words), SEED)
    return np.unique(window_hashes(words, size, SEED))


def shingle_sets(texts: list[bytes | None], hashes: WordHashes, size: int) -> list[np.ndarray]:
    words = [(t or b"").lower().split() for t in texts]
    flat = hashes.of([w for x in words for w in x])
    bounds = np.cumsum([0, *map(len, words)])
    return [shingle_set(flat[a:b], size) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, signature, longer)``: 128 bits naming the shingle set, the ``COORDINATES``
    MinHash values of 32 bits that are posted, and the low 16 bits of ``LONGER`` values, these among them, in a row.
    """
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        factors = (odd_numbers(LONGER, SEED) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        shifts = (mix(odd_numbers(LONGER, SEED + 1)) >> np.uint64(32)).astype(np.uint32)[:, None]
        for batch in slices(batches, text):
            sizes, firsts, seconds, rows, longer = [], [], [], [], []
            for found in shingle_sets(texts_as_bytes(batch.column(text)), hashes, size):
                name = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                firsts.append((name >> 64) - (1 << 63))
                seconds.append((name & ((1 << 64) - 1)) - (1 << 63))
                least = np.full((LONGER, 1), np.uint32((1 << 32) - 1))
                short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
                for i in range(0, len(short), 1024):
                    least = np.minimum(least, ((short[i : i + 1024] ^ shifts) * factors).min(1, keepdims=True))
                rows.append(least[:COORDINATES, 0].view(np.int32))
                longer.append(least[:, 0].astype(np.uint16).tobytes())
            starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()),
                    pa.ListArray.from_arrays(starts, pa.array(np.concatenate(rows))), pa.array(longer, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "longer"],
            )
        del hashes
        give_back()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>, longer binary"
    )


def matrix(signatures: pd.Series) -> np.ndarray:
    """One row of ``LONGER`` coordinates per signature."""
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, LONGER)


def postings(reps: DataFrame) -> DataFrame:
    """``(coord, value, id, n)``: the coordinates in the prefix of each document that others share.

    Coordinates are put in one global order, rarest first. Two documents that agree in at least ``MATCHES``
    coordinates agree in one of the first ``COORDINATES - MATCHES + 1`` of each, so the others, which are the
    frequent ones, are posted by nobody. Coordinates of a single document come first and need no posting.
    """
    every = reps.select("id", F.posexplode("signature").alias("coord", "value"))
    shared = every.groupBy("coord", "value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    known = every.join(shared, ["coord", "value"])
    prefix = (
        known.groupBy("id")  # at most COORDINATES rows a group
        .agg(F.array_sort(F.collect_list(F.struct("freq", "coord", "value"))).alias("p"))
        .select("id", F.slice("p", 1, F.greatest(F.size("p") - (MATCHES - 1), F.lit(0))).alias("p"))
        .where(F.size("p") > 0)
    )
    return stage(
        prefix.join(reps.select("id", "n"), "id")
        .select("id", "n", F.explode("p").alias("p"))
        .select("p.coord", "p.value", "id", "n")
    )


def once(pairs: DataFrame) -> DataFrame:
    """Each pair ``(a, b)`` in one of its cells."""
    return pairs.groupBy("a", "b").agg(F.min("cell").alias("cell"), F.max("n").alias("n"))


def cell_of(home: Column, guest: Column) -> Column:
    """Where a pair was found: the posting, and a block of it on either side."""
    return F.struct("coord", "value", home.cast("int").alias("h"), guest.cast("int").alias("g"))


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough; ``texts`` has one row ``(id, t)`` per end.

    Pairs of a cell share most of their documents, so a cell gets each text once. Cells of long documents are cut
    further, so that either side has about ``CELL_SHINGLES`` shingles or is a single document.
    """
    cuts = F.least(F.lit(BLOCK), F.ceil(F.col("n") * BLOCK / CELL_SHINGLES)).cast("int")
    part = lambda end: F.pmod(F.xxhash64(end, F.lit(7)), F.col("cuts")).cast("int")
    keyed = pairs.withColumn("cuts", cuts).select("a", "b", "cell", "cuts", part("a").alias("p"), part("b").alias("q"))
    key = ["cell", "cuts", "p", "q"]
    ends = keyed.select(*key, F.col("a").alias("id")).union(keyed.select(*key, F.col("b").alias("id"))).distinct()
    known = ends.join(texts, "id").select(*key, F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "t")
    rows = known.union(keyed.select(*key, "a", "b", F.lit(None).cast("string").alias("t")))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        told, asked = cell[cell.b.isna()], cell[cell.b.notna()]
        ids = told.a.to_numpy()
        sets = shingle_sets([t.encode() for t in told.t], WordHashes(), size)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        words, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        by_id = np.argsort(ids)
        left, right = (by_id[np.searchsorted(ids[by_id], asked[e].to_numpy(np.int64))] for e in "ab")
        order = np.argsort(left, kind="stable")
        left, right, close = left[order], right[order], np.zeros(len(order), bool)
        bounds = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
        has = np.zeros(len(words) + 1, bool)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            mine = codes[starts[left[i]] : starts[left[i] + 1]]
            has[mine] = True
            both = np.array([np.count_nonzero(has[codes[starts[k] : starts[k + 1]]]) for k in right[i:j]])
            has[mine] = False
            close[i:j] = both * 100 >= (len(mine) + sizes[right[i:j]] - both) * percent
        return pd.DataFrame({"a": ids[left[close]], "b": ids[right[close]]})

    return rows.groupBy(*key).applyInPandas(compare, "a long, b long")


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that collide in ``LONGER_MATCHES`` coordinates of the longer signature."""

    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series((matrix(left) == matrix(right)).sum(1) >= LONGER_MATCHES)

    a, b = [reps.select(F.col("id").alias(e), F.col("longer").alias(f"s_{e}")) for e in "ab"]
    return (
        pairs.join(a, "a").join(b, "b").where(F.pandas_udf(check, "boolean")("s_a", "s_b")).select("a", "b", "cell", "n")
    )


def colliding(home: pd.DataFrame, guest: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per home its row, and rows and collisions of the guests of other groups and like size that collide often enough."""
    x, y = matrix(home.longer), matrix(guest.longer)
    n, c = guest.n.to_numpy(), guest.c.to_numpy()
    for i, (row, m, group) in enumerate(zip(x, home.n, home.c, strict=True)):
        fits = np.flatnonzero((c != group) & (n * 100 >= m * percent) & (m * 100 >= n * percent))
        same = (y[fits] == row).sum(1)
        yield i, fits[same >= LONGER_MATCHES], same[same >= LONGER_MATCHES]


def linked_in_blocks(dense: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the groups ``c`` of documents that share a posting of ``dense``.

    The largest group of a posting need not meet itself: the documents outside it, the homes, meet all documents,
    the guests, in blocks of about ``BLOCK`` by ``BLOCK`` documents and ``CELL_SHINGLES`` shingles. A task first tells
    which documents of its block collide with another; these come back with their texts, and it compares their
    pairs in full, most collisions first, leaving out those that are in one group by then. So a block returns
    fewer links than it has groups, however many of its pairs are similar.
    """
    key = ["coord", "value"]
    sizes = dense.groupBy(*key, "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    blocks = lambda k, s: F.greatest(F.lit(1), F.ceil(k / BLOCK), F.ceil(s / CELL_SHINGLES)).cast("int")
    grid = (
        sizes.groupBy(*key)
        .agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.max(F.struct("k", "c", "s")).alias("most"))
        .where(F.col("most.k") < F.col("k"))
        .select(
            *key, F.col("most.c").alias("most"),
            blocks(F.col("k") - F.col("most.k"), F.col("s") - F.col("most.s")).alias("homes"), blocks(F.col("k"), F.col("s")).alias("guests"),
        )
    )
    placed = dense.join(grid, key).join(reps.select("id", "longer"), "id")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = placed.where("c <> most").select(
        *key, place("homes").alias("h"), every("guests").alias("g"), F.lit(True).alias("home"), "id", "n", "c", "longer"
    )
    guest = placed.select(*key, every("homes").alias("h"), place("guests").alias("g"), F.lit(False).alias("home"), "id", "n", "c", "longer")
    columns = [*key, "h", "g", "home", "id", "n", "c", "longer"]
    schema = "coord int, value int, h int, g int, home boolean, id long, n long, c long, longer binary"

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        home, guest = cell[cell.home], cell[~cell.home]
        mine, theirs = np.zeros(len(home), bool), np.zeros(len(guest), bool)
        for i, hits, _ in colliding(home, guest, percent):
            mine[i] = len(hits) > 0
            theirs[hits] = True
        return pd.concat([home[mine], guest[theirs]])[columns]

    def confirm(cell: pd.DataFrame) -> pd.DataFrame:
        home, guest = cell[cell.home], cell[~cell.home]
        pairs = [(np.full(len(j), i), j, n) for i, j, n in colliding(home, guest, percent)]
        first, second, same = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else ([], [], np.zeros(0))
        ids = [home.id.to_numpy(), guest.id.to_numpy()]
        every = pd.concat([home, guest]).drop_duplicates("id")
        at = dict(zip(every.id, range(len(every)), strict=True))
        sets = shingle_sets([t.encode() for t in every.t], WordHashes(), size)
        group = dict(zip(every.id, every.c, strict=True))
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        out = []
        for k in np.argsort(-same, kind="stable"):
            a, b = int(ids[0][first[k]]), int(ids[1][second[k]])
            c, d = root(group[a]), root(group[b])
            if c != d:
                x, y = sets[at[a]], sets[at[b]]
                both = len(x) + len(y) - len(np.union1d(x, y))
                if both * 100 >= (len(x) + len(y) - both) * percent:
                    up[c] = d
                    out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    met = home.union(guest).groupBy(*key, "h", "g").applyInPandas(meet, schema)
    return met.join(texts, "id").groupBy(*key, "h", "g").applyInPandas(confirm, "a long, b long")


def pairs_apart(grouped: DataFrame) -> tuple[float, int]:
    """Pairs that share a posting but no group, counted once per posting, and the posted rows."""
    sizes = grouped.groupBy("coord", "value", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = sizes.groupBy("coord", "value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    total = per.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
    return total.pairs or 0.0, int(total.n or 0)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document: near-duplicate groups by their smallest id.

    Documents with the same shingle set become one. The others are posted under their rare signature
    coordinates. While postings hold many more pairs than rows, and the last round halved them, every document of
    a posting is compared with one of it, the smallest and then others, unless both are in one group by now: that
    joins large groups at a cost linear in their size. Then the remaining pairs of a posting that lie in different
    groups, are of like size and collide in at least ``LONGER_MATCHES`` coordinates of the longer signature: of small
    postings by a join, of postings with more than ``DENSE`` documents in blocks, which return only links that join
    groups. All links are confirmed on full shingle sets.

    Null and empty texts, and null ids, have no links and stay; repeated rows of one id are one document with
    the text of any of them, and keep a row each; ids are compared as numbers; other columns are ignored.
    """
    sets = stage(signatures(docs, key, text, size), "signatures")
    some = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    names = ["set_a", "set_b", "n_shingles"]
    classes = stage(
        some.groupBy(*names).agg(
            F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first(F.struct("signature", "longer")).alias("s")
        )
    )
    many = classes.where("last > id").select(*names, "id")
    copies = join_lookup(some.select(*names, "doc_id"), many, names).where("doc_id > id")
    exact = copies.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    reps = classes.groupBy("id").agg(F.max(F.struct(F.col("n_shingles").alias("n"), "s.signature", "s.longer")).alias("r"))
    reps = reps.select("id", "r.*")
    reps = stage(reps)
    posted = postings(reps)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    texts = stage(texts.join(posted.select("id").distinct(), "id").groupBy("id").agg(F.first("t").alias("t")), "candidates")
    fits = (F.col("n") * 100 >= F.col("n_2") * percent) & (F.col("n_2") * 100 >= F.col("n") * percent)
    other = (F.col("id") != F.col("id_2")) & (F.col("c") != F.col("c_2"))
    pair = F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"), F.greatest("n", "n_2").alias("n")
    second = lambda frame, *more: frame.select(
        "coord", "value", *[F.col(c).alias(f"{c}_2") for c in ("id", "n", "c", *more)]
    )

    grouped, links, tested = posted.withColumn("c", F.col("id")), None, None
    before = float("inf")
    for turn in range(STAR_ROUNDS):
        pairs, rows = pairs_apart(grouped)
        if pairs <= WORTH * rows or pairs * 2 > before:
            break
        before = pairs
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        least = F.min(F.struct(order.alias("o"), "id", "n", "c")).alias("f")
        heads = grouped.groupBy("coord", "value").agg(least, F.count(F.lit(1)).alias("k"))
        blocks = second(heads.select("coord", "value", "f.*", "k"), "k")
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("k_2") / BLOCK))
        stars = grouped.join(blocks, ["coord", "value"]).where(other & fits)
        stars = once(stars.select(*pair, cell_of(F.lit(0), block).alias("cell")))
        stars = stars if tested is None else stars.join(tested, ["a", "b"], "left_anti")
        stars = stage(alike(stars, reps))
        if stars.isEmpty():
            break
        seen = stars.select("a", "b")
        tested = seen if tested is None else tested.union(seen)
        new = stage(verify(stars, texts, size, percent))
        links = new if links is None else links.union(new)
        groups = components(links).withColumnRenamed("component", "c")
        grouped = stage(posted.join(groups, "id", "left").withColumn("c", F.coalesce("c", "id")))
    crowd = grouped.groupBy("coord", "value").agg(F.count(F.lit(1)).alias("k"))
    sized = stage(grouped.join(crowd, ["coord", "value"]))
    small, dense = sized.where(F.col("k") <= DENSE).drop("k"), sized.where(F.col("k") > DENSE).drop("k")
    across = small.join(second(small), ["coord", "value"]).where((F.col("id") < F.col("id_2")) & other & fits)
    across = alike(once(across.select(*pair, cell_of(F.lit(0), F.lit(0)).alias("cell"))), reps)
    across = stage(across if tested is None else across.join(tested, ["a", "b"], "left_anti"))
    found = verify(across, texts, size, percent).union(linked_in_blocks(dense, reps, texts, size, percent))
    links = found if links is None else links.union(found)
    joined = components(links.union(exact))
    return (
        sets.select("doc_id", "n_shingles")
        .join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
