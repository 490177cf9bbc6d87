"""Filters, cleaning and de-duplication of raw comment rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.functions import normalize as N
from forumloom.operators.skew import first_per_key
from forumloom.schema import COMMENT_SCHEMA, FORUM, KEY, TEXT


def drop_deleted(comments: DataFrame, text: str = TEXT) -> DataFrame:
    """Drop rows whose text is exactly a deletion marker; null text stays."""
    return comments.where(~N.is_deletion_marker(F.col(text)))


def drop_quote_characters(comments: DataFrame, text: str = TEXT) -> DataFrame:
    return comments.withColumn(text, N.drop_quote_characters(F.col(text)))


def drop_empty(comments: DataFrame, text: str = TEXT) -> DataFrame:
    """Empty text counts as missing; drop rows without text."""
    return comments.where(F.col(text) != "")


def clean(comments: DataFrame, text: str = TEXT) -> DataFrame:
    """Drop deleted rows, then quote characters, then empty rows: a marker inside quotes survives.

    Whether a row will be empty is decided on its first character that is not a quote, so the quotes are
    removed once, in the projection, and not again in the filter.
    """
    kept = comments.where(~N.is_deletion_marker(F.col(text)) & N.has_more_than_quotes(F.col(text)))
    return kept.transform(drop_quote_characters, text)


def keep_first(df: DataFrame, key: str = KEY, order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first in ``order``, remaining ties broken by the row's own values."""
    return first_per_key(df, [key], order)


def merge_comments(new: DataFrame, existing: DataFrame, key: Sequence[str] = (FORUM, KEY)) -> DataFrame:
    """New rows win over existing ones; inside each side the smallest row wins."""
    existing = conform(existing, new.schema)
    both = new.withColumn("_source", F.lit(0)).unionByName(existing.withColumn("_source", F.lit(1)))
    return first_per_key(both, key, [F.col("_source")]).drop("_source")


def distinct_posts(*rankings: DataFrame, key: str = "post_id") -> DataFrame:
    """Union of ranked post lists in which each post appears once, from the earliest list that has it."""
    tagged = [posts.withColumn("_list", F.lit(i)) for i, posts in enumerate(rankings)]
    both = tagged[0]
    for other in tagged[1:]:
        both = both.unionByName(other)
    return first_per_key(both, [key], [F.col("_list")]).drop("_list")


def top_per_forum(posts: DataFrame, score: str, limit: int | None, forum: str = FORUM, key: str = "post_id") -> DataFrame:
    """The ``limit`` best posts of each forum, ties broken by key; without a limit all posts.

    Spark prunes to the limit inside each task before it shuffles, so a large forum sends few rows.
    """
    if limit is None:
        return posts
    rank = F.row_number().over(Window.partitionBy(forum).orderBy(F.col(score).desc(), F.col(key)))
    return posts.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def drop_done(comments: DataFrame, done: DataFrame, key: str = KEY, require_rows: bool = False) -> DataFrame:
    """Rows whose key is not in ``done``; with ``require_rows`` an empty result is an error."""
    left = comments.join(done.select(key).distinct(), key, "left_anti").select(*comments.columns)
    if require_rows and left.isEmpty():
        raise ValueError("all comments have already been processed")
    return left


def drop_done_forums(comments: DataFrame, done: DataFrame, forum: str = FORUM) -> DataFrame:
    """Rows of forums of which nothing is stored yet."""
    return comments.join(done.select(forum).distinct(), forum, "left_anti").select(*comments.columns)


def keep_forums(comments: DataFrame, forums: DataFrame, forum: str = FORUM) -> DataFrame:
    """Rows of the listed forums."""
    return comments.join(forums.select(forum).distinct(), forum, "left_semi").select(*comments.columns)


def keep_ids(comments: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is listed."""
    return comments.join(ids.select(key), key, "left_semi").select(*comments.columns)


def project_comments(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Select the five comment columns from fetched rows, renaming and casting.

    ``names`` maps target columns to source expressions; the defaults rename ``id``, ``ups`` and ``body``.
    """
    source = {
        "comment_id": "id",
        "post_id": "post_id",
        "subreddit": "subreddit",
        "text": "body",
        "upvotes": "ups",
        **(names or {}),
    }
    return raw.select(*[F.expr(source[f.name]).cast(f.dataType).alias(f.name) for f in COMMENT_SCHEMA])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the schema's types and order, by column name."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
