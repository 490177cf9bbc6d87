"""Comment trees flattened to rows in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.operators.order import with_group_positions
from forumloom.operators.skew import hot_keys, join_lookup
from forumloom.session import cut

_SEGMENT = 19  # digits per level, all of a BIGINT; keeps the text order of paths equal to the order of sibling numbers


def flatten_threads(
    replies: DataFrame,
    post: str = "post_id",
    node: str = "comment_id",
    parent: str = "parent_id",
    sibling_order: str = "sibling",
    max_rounds: int = 64,
) -> DataFrame:
    """Add ``depth`` (0 for top-level comments) and ``path`` to every reply reachable from a top-level one.

    Sorting a post by ``path`` visits its trees depth-first, parents before children. Ancestor pointers
    are doubled each round, so a chain of depth d takes about log2(d) joins, not d. Rows that have reached
    their root leave the loop. Each round is cut to reliable storage.
    ``sibling_order`` is a non-negative integer that numbers the replies of one parent; replies of equal
    number are told apart by a digest of their id. A pointer that has climbed more levels than its post has nodes
    is in a cycle, which is an error.
    """
    number = F.col(sibling_order).cast("long")
    digits = F.when(number >= 0, F.lpad(number.cast("string"), _SEGMENT, "0")).when(
        number.isNotNull(), F.raise_error(F.lit("sibling numbers may not be negative"))
    )
    segment = F.concat(digits, F.lit("."), F.substring(F.md5(F.col(node).cast("string").cast("binary")), 1, 16))
    sizes = replies.groupBy(post).agg(F.count(F.lit(1)).alias("_size"))
    nodes = cut(
        join_lookup(replies, sizes, [post]).select(
            post,
            node,
            F.col(parent).alias("_anc"),
            F.lit(0).alias("_up"),
            segment.alias("path"),
            "_size",
        )
    )
    pending, done = nodes.where(F.col("_anc").isNotNull()), nodes.where(F.col("_anc").isNull())
    finished = [done]
    for _ in range(max_rounds):
        if pending.isEmpty():
            break
        if not pending.where(F.col("_up") >= F.col("_size")).isEmpty():
            raise ValueError("parent pointers form a cycle")
        # where each pointer target itself points to: finished targets end the climb
        resolved = finished[0]
        for part in finished[1:]:
            resolved = resolved.unionByName(part)
        targets = resolved.unionByName(pending).select(
            post, F.col(node).alias("_anc"), F.col("_anc").alias("_next"), F.col("_up").alias("_more"),
            F.col("path").alias("_prefix"),
        )
        keys = [post, "_anc"]
        moved = cut(
            join_lookup(pending, targets, keys, hot=hot_keys(pending, keys)).select(
                post,
                node,
                F.col("_next").alias("_anc"),
                (F.col("_up") + F.col("_more") + 1).alias("_up"),
                F.concat_ws("/", "_prefix", "path").alias("path"),
                "_size",
            )
        )
        finished.append(moved.where(F.col("_anc").isNull()))
        pending = moved.where(F.col("_anc").isNotNull())
    else:
        raise ValueError("parent pointers form a cycle")
    flat = finished[0]
    for part in finished[1:]:
        flat = flat.unionByName(part)
    return replies.join(flat.select(post, node, F.col("_up").alias("depth"), "path"), [post, node])


def number_comments(flat: DataFrame, post: str = "post_id", order: list[str | Column] | None = None) -> DataFrame:
    """Add ``num_comment`` (1-based, in pre-order) and ``num_comments`` of the post.

    Positions come from a range sort, so a post with most of the comments is numbered by many tasks.
    """
    placed = with_group_positions(flat, [post], order or ["path"], "_pos")
    placed = placed.withColumn("_post", F.struct(post))  # null-safe, as for positions
    totals = flat.groupBy(F.struct(post).alias("_post")).agg(F.count(F.lit(1)).alias("num_comments"))
    return (
        join_lookup(placed, totals, ["_post"])
        .withColumn("num_comment", F.col("_pos") + 1)
        .drop("_pos")
        .select(*flat.columns, "num_comment", "num_comments")
    )


def number_posts(posts: DataFrame, group: str = "subreddit", order: list[str | Column] | None = None) -> DataFrame:
    """Add the ``post_counter`` text ``i/n`` of each post inside its group."""
    placed = with_group_positions(posts, [group], order or ["post_id"], "_pos")
    placed = placed.withColumn("_group", F.struct(group))
    totals = posts.groupBy(F.struct(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        join_lookup(placed, totals, ["_group"])
        .withColumn("post_counter", F.concat_ws("/", (F.col("_pos") + 1).cast("string"), F.col("_n").cast("string")))
        .select(*posts.columns, "post_counter")
    )
