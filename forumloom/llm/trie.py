"""Conversation prefix trie: balanced parentheses per shard, and the spines that shards share merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.llm.common import prepare, stage
from forumloom.operators.order import with_group_positions
from forumloom.operators.skew import HOT_SHARE, fits_broadcast, join_lookup

SEGMENT = 128
"""Turns of a conversation that are one row; longer conversations go in levels of segments."""

SHARD_TURNS = 1 << 18
"""Turns that a task encodes at once."""

KEY = 16
"""Bytes of a turn's key: SHA-256 of its role and text, cut off."""

BLOCK = 64
FAR = np.iinfo(np.int64).max
SPINE_ROWS = 200_000
START = bytes(KEY)
NONE = hashlib.sha256(b"").hexdigest()


# Balanced parentheses --------------------------------------------------------------------------------


class Parentheses:
    """A bit string (1 opens, 0 closes) with its excess in blocks under a tree of their minima."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.excess = np.concatenate([excess, np.full(-len(excess) % BLOCK, FAR)])
        self.minima = [self.excess.reshape(-1, BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            below = np.append(below, FAR) if len(below) % 2 else below
            self.minima[-1] = below
            self.minima.append(below.reshape(-1, 2).min(axis=1))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing position of each opening one: own block, then up and down the tree, then one more block."""
        target, found = self.excess[at] - 1, np.full(len(at), -1)
        self._scan(at + 1, target, found, np.arange(len(at)))
        todo = np.flatnonzero(found < 0)
        block, goal = at[todo] // BLOCK, target[todo]
        level = np.full(len(todo), -1)
        climbing = np.arange(len(todo))
        for depth, low in enumerate(self.minima[:-1]):
            here = block[climbing]
            right = np.where(here % 2 == 0, low[np.minimum(here + 1, len(low) - 1)], FAR)
            hit = right <= goal[climbing]
            level[climbing[hit]] = depth
            block[climbing[hit]] += 1
            climbing = climbing[~hit]
            block[climbing] //= 2
        for depth in range(len(self.minima) - 2, 0, -1):
            down = np.flatnonzero(level >= depth)
            left = 2 * block[down]
            block[down] = np.where(self.minima[depth - 1][left] <= goal[down], left, left + 1)
        self._scan(block * BLOCK, target, found, todo)
        return found

    def _scan(self, start: np.ndarray, target: np.ndarray, found: np.ndarray, rows: np.ndarray) -> None:
        """First position with the target excess from ``start`` to the end of its block."""
        while len(rows):
            inside = start < len(self.excess)
            hit = np.zeros(len(rows), bool)
            hit[inside] = self.excess[start[inside]] == target[rows[inside]]
            found[rows[hit]] = start[hit]
            on = ~hit & ((start + 1) % BLOCK != 0)
            rows, start = rows[on], start[on] + 1


# One shard -------------------------------------------------------------------------------------------

_OUT = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("kind", T.IntegerType()), ("conv_id", T.LongType()), ("depth", T.LongType()), ("parent_conv_id", T.LongType()),
            ("parent", T.BinaryType()), ("node", T.BinaryType()), ("path", T.ArrayType(T.BinaryType())),
            ("n_convs", T.LongType()), ("n_children", T.LongType()), ("n_leaves", T.LongType()), ("saved", T.LongType()),
            ("n_bytes", T.LongType()), ("ends", T.StringType()), ("x_children", T.LongType()), ("x_leaves", T.LongType()),
            ("x_saved", T.LongType()), ("x_ends", T.StringType()),
        )
    ]
)
COMPLETE, SPINE, ENDS = 0, 1, 2


def _path(start: bytes, keys: bytes) -> list[bytes]:
    """Identities of the nodes along one segment: digests of the level's start and the keys so far."""
    digest, found = hashlib.sha256(start), [start]
    for i in range(0, len(keys), KEY):
        digest.update(keys[i : i + KEY])
        found.append(digest.digest()[:KEY])
    return found


def encode_shard(rows: list[dict]) -> list[dict]:
    """Nodes of the trie of some sorted segments.

    Nodes on the paths of the first and the last segment may lie in other shards too: they come as ``SPINE`` rows
    with what this shard has below them, without other spine nodes. All others are ``COMPLETE``.
    """
    n = len(rows)
    ids = np.array([r["conv_id"] for r in rows] + [FAR], np.int64)
    lens = np.array([len(r["keys"]) // KEY + 1 for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r["start"] + r["keys"] for r in rows), np.uint64).reshape(-1, 2)
    sizes = np.concatenate([[0, *r["sizes"]] for r in rows]).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    seg = np.repeat(np.arange(n), lens)
    at = np.arange(off[-1]) - off[seg]
    before = np.flatnonzero((seg > 0) & (at < lens[seg - 1]))
    same = np.zeros(off[-1], bool)
    same[before] = (flat[before] == flat[off[seg[before] - 1] + at[before]]).all(axis=1)
    shared = np.minimum.reduceat(np.where(same, lens[seg], at), off[:-1])  # turns in common with the segment before
    closes = np.concatenate([[0], lens[:-1] - shared[1:]])
    opens = lens - shared
    runs = np.append(np.stack([closes, opens], axis=1).ravel(), lens[-1])
    bits = np.repeat(np.append(np.tile([0, 1], n), 0), runs).astype(np.uint8)
    tree = Parentheses(bits)

    new = at >= shared[seg]
    first, depth, n_bytes = seg[new], at[new], sizes[new]
    m = len(first)
    open_at = np.flatnonzero(bits)
    close_at = tree.find_close(open_at)
    turn = np.cumsum(closes) + np.concatenate([[0], np.cumsum(opens)[:-1]])  # where each segment's opens begin
    end = np.searchsorted(turn, close_at, "right")
    members = end - first
    smallest = np.minimum.reduceat(ids, np.stack([first, end], axis=1).ravel())[::2]
    order = np.sort(depth * m + np.arange(m))
    up = (depth - 1) * m
    parent = np.where(depth > 0, order[np.searchsorted(order, up + np.arange(m)) - 1] - up, -1)
    spine = np.zeros(m, bool)
    spine[: lens[0]] = True
    spine[close_at >= len(bits) - lens[-1]] = True

    last = np.cumsum(opens) - 1  # the node at which each segment ends
    leaves = (bits[open_at + 1] == 0).astype(np.int64)  # a leaf pair is an opening right before a closing
    saved = (members - 1) * n_bytes
    beyond: dict[int, dict] = {}
    for i, r in enumerate(rows):
        if r["x_leaves"] is not None:
            beyond[int(last[i])] = r
    for node, r in beyond.items():
        leaves[node] = r["x_leaves"]
        saved[node] += r["x_saved"]
    size = (close_at - open_at + 1) // 2
    below = lambda weight: (s := np.concatenate([[0], np.cumsum(weight)]))[np.arange(m) + size] - s[:m]
    own = ~spine
    all_leaves, all_saved = below(leaves * own), below(saved * own)
    children = np.bincount(parent[own & (parent >= 0)], minlength=m)

    names: dict[int, tuple[bytes, list[bytes]]] = {}
    for i, nodes in ((0, np.arange(lens[0])), (n - 1, np.flatnonzero(close_at >= len(bits) - lens[-1]))):
        path = _path(rows[i]["start"], rows[i]["keys"])
        for node in nodes.tolist():
            names[node] = (path[depth[node]], path[: depth[node] + 1])

    ends: dict[int, list[str]] = {}
    for i, r in enumerate(rows):
        if r["next"] is None:
            ends.setdefault(int(last[i]), []).append(str(r["conv_id"]))

    found = []
    blank = dict.fromkeys(_OUT.names)
    for v in range(m):
        text = ",".join(ends[v]) if v in ends else None
        extra = beyond.get(v)
        row = blank | {"conv_id": int(smallest[v]), "depth": int(depth[v]), "n_convs": int(members[v])}
        row |= {"n_children": int(children[v]), "n_leaves": int(all_leaves[v]), "saved": int(all_saved[v])}
        if v in names:
            row |= {"kind": SPINE, "node": names[v][0], "path": names[v][1], "n_bytes": int(n_bytes[v])}
            if extra:
                row |= {x: extra[x] for x in ("x_children", "x_leaves", "x_saved", "x_ends")}
            if text is not None:
                found.append(blank | {"kind": ENDS, "node": names[v][0], "conv_id": int(ends[v][0]), "ends": text})
        else:
            digest = NONE if text is None else hashlib.sha256(text.encode()).hexdigest()
            row |= {"kind": COMPLETE, "ends": extra["x_ends"] if extra else digest}
            row["n_children"] = extra["x_children"] if extra else row["n_children"]
            p = int(parent[v])
            if p < 0:
                row["node"] = rows[first[v]]["start"]
            elif p in names:
                row["parent"] = names[p][0]
            else:
                row["parent_conv_id"] = int(smallest[p])
        found.append(row)
    return found


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_OUT)
    held, turns = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            turns += len(row["sizes"]) + 1
            if turns >= SHARD_TURNS:
                yield pa.RecordBatch.from_pylist(encode_shard(held), schema)
                held, turns = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(encode_shard(held), schema)


# Rebuilt conversations -------------------------------------------------------------------------------


def default_head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations ``(conv_id, at, key, n_bytes)``, and ``(conv_id, length)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("_turn"),
        F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 2 * KEY)).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    placed = stage(with_group_positions(rows, ["conv_id"], [F.asc_nulls_first("_turn"), "key"], "_at").drop("_turn"), "turns")
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.least(default_head(F.col("conv_id")), F.lit(most).cast("long"))
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), head.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    taken = F.least("h", F.coalesce("_n", F.lit(0).cast("long")))
    convs = own.join(bases, "base", "left").withColumn("taken", taken)
    convs = stage(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("_at") < most)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "h"), "base").where(F.col("_at") < F.col("h"))
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = convs.where(F.col("n") * HOT_SHARE > total).select("conv_id")
    rest = join_lookup(placed, convs.select("conv_id", "h", "taken"), ["conv_id"], hot=hot)
    rest = rest.where(F.col("_at") >= F.col("h")).withColumn("_at", F.col("taken") + F.col("_at") - F.col("h"))
    columns = ["conv_id", F.col("_at").alias("at"), "key", "n_bytes"]
    return heads.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "length")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of the segments of long conversations, whose full segments come in order: a running digest."""
    names = ["conv_id", "seg", "start", "next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    conv, seg, start = None, 0, START
    for batch in batches:
        out = []
        for c, s, digest in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "seg", "digest")], strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, seg + 1, start, None))
                conv, start = c, START
            seg, follows = s, hashlib.sha256(start + digest.encode()).digest()[:KEY]
            out.append((c, s, start, follows))
            start = follows
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conv, seg + 1, start, None), kinds, strict=True)], names)


def segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, seg, start, keys, sizes, next)``: keys and sizes of at most ``segment`` turns in order.

    A conversation whose length is a multiple of ``segment`` also has an empty last segment, so that all members
    of the node before it go on to the next level.
    """
    cells = F.sort_array(F.collect_list(F.struct("at", "key", "n_bytes")))
    packed = (
        turns.withColumn("seg", F.floor(F.col("at") / segment).cast("long")).groupBy("conv_id", "seg").agg(cells.alias("c"))
    )
    join = F.aggregate("c.key", F.lit(b"").cast("binary"), lambda all_, key: F.concat(all_, key))
    packed = packed.select("conv_id", "seg", join.alias("keys"), F.col("c.n_bytes").alias("sizes"))
    empty = convs.where(F.col("length") % segment == 0).select(
        "conv_id",
        F.floor(F.col("length") / segment).cast("long").alias("seg"),
        F.lit(b"").cast("binary").alias("keys"),
        F.array().cast("array<long>").alias("sizes"),
    )
    packed = stage(packed.unionByName(empty), "segments")
    full = packed.where(F.size("sizes") == segment).select("conv_id", "seg", F.sha2("keys", 256).alias("digest"))
    chain = full.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    chain = chain.mapInArrow(_chained, "conv_id long, seg long, start binary, next binary")
    return packed.join(chain, ["conv_id", "seg"], "left").withColumn(
        "start", F.coalesce("start", F.lit(START).cast("binary"))
    )


# Levels ----------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of its id lists, which come in order."""
    node, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])
    for batch in batches:
        for key, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    yield row()
                node, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(("," + text).encode())
    if node is not None:
        yield row()


def _merged(shards: DataFrame) -> DataFrame:
    """Spine nodes, once each, with totals over all shards and over the spine nodes below them."""
    parts = shards.where(F.col("kind") == SPINE)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    same = [F.max(c).alias(c) for c in ("depth", "n_bytes", "x_children", "x_leaves", "x_saved", "x_ends")]
    spine = parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), *sums, *same)
    spine = spine.withColumn("parent", F.when(F.size("path") > 1, F.element_at("path", -2)))
    spine = stage(spine, "spine")
    inner = spine.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_spine_children"))
    lists = shards.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    lists = lists.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node binary, ends string")
    spine = spine.join(inner, "node", "left").join(lists, "node", "left")
    children = F.coalesce("x_children", F.col("n_children") + F.coalesce("_spine_children", F.lit(0)))
    spine = spine.withColumn("n_children", children).withColumn("ends", F.coalesce("x_ends", "ends", F.lit(NONE)))
    leaf = F.coalesce("x_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    own = (F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("x_saved", F.lit(0))
    spine = stage(spine.withColumn("_leaf", leaf).withColumn("_own", own), "spine")
    above = spine.select(F.explode("path").alias("node"), "_leaf", "_own")
    above = above.groupBy("node").agg(F.sum("_leaf").alias("_leaves"), F.sum("_own").alias("_saved"))
    total = spine.join(above, "node").withColumn("n_leaves", F.col("n_leaves") + F.col("_leaves"))
    total = total.withColumn("saved", F.col("saved") + F.col("_saved"))
    parents = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return stage(total.join(parents, "parent", "left").select(*_NODE), "spine")


_NODE = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]


def prefix_trie(
    conversations: DataFrame, family: int = 5, most: int = 8, segment: int = SEGMENT
) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations.

    ``conversations`` has ``conv_id, turn, role, text``. Conversation c is rebuilt from the first h turns of
    conversation c - c % ``family`` (h = crc32 of the decimal c, modulo 9, at most ``most``) and its own turns after its
    first h. A node is a distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``.

    Turns are keys of 16 bytes. Sorted by key sequence and id, conversations fall into shards, each of which is one
    string of balanced parentheses. Only nodes on a shard's first and last path can be in another shard; these
    spines are merged by the digest of their path. Equal conversations may fill many shards. A conversation goes in
    segments of ``segment`` turns, one level after the other from the deepest, so its length is not bounded either.
    The ids that end at one node pass through one digest, in lists of a shard each.

    Rows without a conv_id belong to no conversation; null role and text are empty; equal turns go in order of
    their keys; repeated rows are turns of their own; an empty table has no nodes. Other columns are ignored.
    """
    prepare(conversations)
    turns, convs = rebuilt(conversations, family, most)
    segs = stage(segments(turns, convs, segment), "segments")
    levels = segs.agg(F.max("seg")).first()[0]
    extras = ["x_children", "x_leaves", "x_saved", "x_ends"]
    nothing = [F.lit(None).cast(k).alias(c) for c, k in zip(extras, ("long", "long", "long", "string"), strict=True)]
    found, roots = None, None
    for level in range(levels if levels is not None else 0, -1, -1):
        own = segs.where(F.col("seg") == level)
        ended = own.where("next IS NULL").select("*", *nothing)
        if roots is not None:
            going = join_lookup(own.where("next IS NOT NULL"), roots.withColumnRenamed("node", "next"), ["next"])
            ended = ended.unionByName(going)
        order = ["start", "keys", "conv_id"]
        ended = ended.select("start", "keys", "sizes", "conv_id", "next", *extras)
        shards = stage(ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encoded, _OUT), "shards")
        spine = _merged(shards)
        whole = shards.where(F.col("kind") == COMPLETE)
        named = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
        under = whole.where("parent IS NOT NULL")
        under = (
            under.join(F.broadcast(named), "parent") if fits_broadcast(named, SPINE_ROWS) else join_lookup(under, named, ["parent"])
        )
        whole = whole.where("parent IS NULL").select(*_NODE).unionByName(
            under.withColumn("parent_conv_id", F.col("_above")).select(*_NODE)
        )
        nodes = whole.unionByName(spine)
        if level:
            top = nodes.where(F.col("depth") == 0)
            renamed = [F.col(c).alias(x) for c, x in zip(("n_children", "n_leaves", "saved", "ends"), extras, strict=True)]
            roots = stage(top.select("node", *renamed), "roots")
            nodes = nodes.where(F.col("depth") > 0)
        nodes = nodes.withColumn("depth", F.col("depth") + level * segment)
        found = nodes if found is None else found.unionByName(nodes)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
