"""Queries over sources, sinks, cleaning, threads, tallies and series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.operators import clean, order, series, split, tally, threads
from forumloom.operators.normalizing import lower_case
from forumloom.schema import COMMENT_SCHEMA
from forumloom.session import staging_path
from forumloom.sources import readers, versions, writers
from workload import tables as t
from workload.registry import query

FIVE = "comment_id, post_id, subreddit, text, upvotes"

# Sources and sinks -----------------------------------------------------------------------------------


@query("a1_scan_parent_folder", f"{t.WITH_RAW} SELECT {FIVE} FROM raw_comments")
def a1(spark, folder):
    return readers.read_comments(spark, t.stored(spark, folder, "raw", t.raw_comments))


@query("a1_scan_forum_folders", f"{t.WITH_RAW} SELECT {FIVE} FROM raw_comments")
def a1_list(spark, folder):
    path = t.stored(spark, folder, "raw", t.raw_comments)
    forums = t.raw_comments(spark, folder).select("subreddit").distinct().collect()
    return readers.read_comments(spark, [f"{path}/subreddit={row.subreddit}" for row in forums])


@query("a2_scan_forum_pattern", f"{t.WITH_RAW} SELECT {FIVE} FROM raw_comments WHERE subreddit LIKE 'src1%'")
def a2(spark, folder):
    return readers.read_comments(spark, t.stored(spark, folder, "raw", t.raw_comments), "src1*")


@query("a3_ignore_other_files", f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments")
def a3(spark, folder):
    path = t.stored(spark, folder, "stray", t.comments)
    spark.range(1).select(F.lit("not a comment").alias("value")).write.mode("append").text(path)
    return readers.read_comments(spark, path)


@query("a4_write_partitioned", f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments")
def a4(spark, folder):
    path = staging_path(spark, "written")
    writers.write_comments(t.comments(spark, folder), path)
    return readers.read_comments(spark, path)


MERGED = f"""{t.WITH_REFETCHED}, both_sides AS (SELECT 0 AS pri, * FROM refetched UNION ALL SELECT 1, * FROM comments)
    SELECT {FIVE} FROM both_sides
    QUALIFY row_number() OVER (PARTITION BY subreddit, comment_id ORDER BY pri, text) = 1"""


@query("a5_merge_write", MERGED)
def a5(spark, folder):
    path = staging_path(spark, "upserted")
    writers.write_comments(t.comments(spark, folder), path)
    writers.upsert_comments(t.refetched(spark, folder), path)
    return readers.read_comments(spark, path)


@query("a5_merge_versions", MERGED)
def a5_versions(spark, folder):
    path = staging_path(spark, "versioned")
    versions.upsert_versioned(t.comments(spark, folder), path)
    versions.upsert_versioned(t.refetched(spark, folder), path)
    versions.drop_old_versions(spark, path, keep=1)
    return versions.read_versioned(spark, path)


@query("a6_write_split_ids", f"{t.WITH_COMMENTS} SELECT comment_id, split FROM ({t.sql_split('comments')})")
def a6(spark, folder):
    path = staging_path(spark, "ids")
    writers.write_ids(split.random_split(t.comments(spark, folder).select("comment_id")), path)
    return readers.read_ids(spark, path)


@query(
    "a9_write_split_texts",
    f"""{t.WITH_COMMENTS}, parts AS ({t.sql_split('comments')})
    SELECT 'all' AS part, comment_id, text FROM comments
    UNION ALL SELECT split, comment_id, text FROM parts""",
)
def a9(spark, folder):
    path = staging_path(spark, "texts")
    texts = t.comments(spark, folder)
    writers.write_split_texts(texts, split.random_split(texts.select("comment_id")), path)
    parts = [
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), "comment_id", "text")
        for name in ("all", "train", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LONG_FORUMS = "SELECT DISTINCT source FROM documents WHERE n_chars > 15000"


@query(
    "a10_forum_list",
    f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments WHERE subreddit IN ({LONG_FORUMS})",
)
def a10(spark, folder):
    path = staging_path(spark, "forums")
    listed = t.table(spark, folder, "documents").where("n_chars > 15000").select("source").distinct()
    listed.write.text(path)
    return clean.keep_forums(t.comments(spark, folder), readers.read_forum_list(spark, path))


# Cleaning --------------------------------------------------------------------------------------------


@query(
    "c1_drop_deleted",
    f"""{t.WITH_RAW} SELECT {FIVE} FROM raw_comments
    WHERE text IS NULL OR text NOT IN ('[deleted]', '[removed]')""",
)
def c1(spark, folder):
    return clean.drop_deleted(t.raw_comments(spark, folder))


@query(
    "c2_drop_quote_characters",
    f"""{t.WITH_RAW} SELECT * REPLACE (regexp_replace(text, '["“”‟„⹂〞〟＂❝❞]', '', 'g') AS text) FROM raw_comments""",
)
def c2(spark, folder):
    return clean.drop_quote_characters(t.raw_comments(spark, folder))


@query("c3_drop_empty", f"{t.WITH_RAW} SELECT {FIVE} FROM raw_comments WHERE text <> ''")
def c3(spark, folder):
    return clean.drop_empty(t.raw_comments(spark, folder))


@query("c4_clean", f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments")
def c4(spark, folder):
    return t.comments(spark, folder)


@query(
    "c5_keep_first",
    f"""{t.WITH_REFETCHED}, both_sides AS (SELECT 0 AS pri, * FROM refetched UNION ALL SELECT 1, * FROM comments)
    SELECT {FIVE} FROM both_sides
    QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY pri, text) = 1""",
)
def c5(spark, folder):
    new = t.refetched(spark, folder).withColumn("pri", F.lit(0))
    old = t.comments(spark, folder).withColumn("pri", F.lit(1))
    return clean.keep_first(new.unionByName(old), "comment_id", [F.col("pri")]).drop("pri")


_RANKED = """SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY {0} DESC, post_id) AS r FROM posts"""


@query(
    "c6_distinct_posts",
    f"""{t.WITH_POSTS}, lists AS (
      SELECT post_id, subreddit, 'top' AS list, 0 AS i FROM ({_RANKED.format('top')}) WHERE r <= 10
      UNION ALL SELECT post_id, subreddit, 'hot', 1 FROM ({_RANKED.format('hot')}) WHERE r <= 10)
    SELECT post_id, subreddit, list FROM lists QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY i) = 1""",
)
def c6(spark, folder):
    posts = t.posts(spark, folder)
    top, hot = (
        clean.top_per_forum(posts, score, 10).select("post_id", "subreddit", F.lit(score).alias("list"))
        for score in ("top", "hot")
    )
    return clean.distinct_posts(top, hot)


@query("c7_top_posts_per_forum", f"{t.WITH_POSTS} SELECT post_id, subreddit, top, hot FROM ({_RANKED.format('top')}) WHERE r <= 10")
def c7(spark, folder):
    return clean.top_per_forum(t.posts(spark, folder), "top", 10)


@query(
    "c8_resume_by_id",
    f"""{t.WITH_COMMENTS} SELECT {FIVE} FROM comments
    WHERE comment_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)""",
)
def c8(spark, folder):
    done = t.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    return clean.drop_done(t.comments(spark, folder), done)


@query("c10_resume_by_forum", f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments WHERE subreddit NOT IN ({LONG_FORUMS})")
def c10(spark, folder):
    done = t.table(spark, folder, "documents").where("n_chars > 15000").select(F.col("source").alias("subreddit"))
    return clean.drop_done_forums(t.comments(spark, folder), done)


@query("c11_empty_input", f"{t.WITH_COMMENTS} SELECT {FIVE} FROM comments WHERE upvotes < 0")
def c11(spark, folder):
    return lower_case(t.comments(spark, folder).where("upvotes < 0"), "text")


@query(
    "c12_project_comments",
    """SELECT CAST(doc_id AS STRING) AS comment_id, 'p' || CAST(doc_id % 97 AS STRING) AS post_id, source AS subreddit,
    text, n_chars AS upvotes FROM documents""",
)
def c12(spark, folder):
    fetched = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("p"), (F.col("doc_id") % 97).cast("string")).alias("link"),
        F.col("source").alias("subreddit"),
        F.col("text").alias("body"),
        F.col("n_chars").cast("int").alias("ups"),
        "lang",
    )
    return clean.project_comments(fetched, {"post_id": "link"})


@query("c13_flatten_threads", f"{t.WITH_REPLIES} SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth, path FROM flat")
def c13(spark, folder):
    flat = threads.flatten_threads(t.replies(spark, folder))
    return flat.select("post_id", "comment_id", F.col("depth").cast("long").alias("depth"), "path")


@query(
    "c14_number_comments",
    f"""{t.WITH_REPLIES} SELECT post_id, comment_id,
      row_number() OVER (PARTITION BY post_id ORDER BY path) AS num_comment,
      count(*) OVER (PARTITION BY post_id) AS num_comments FROM flat""",
)
def c14(spark, folder):
    flat = threads.flatten_threads(t.replies(spark, folder)).select("post_id", "comment_id", "path")
    return threads.number_comments(flat).drop("path")


@query(
    "c14_post_counter",
    f"""{t.WITH_POSTS} SELECT post_id, subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY top DESC, post_id)
      || '/' || count(*) OVER (PARTITION BY subreddit) AS post_counter FROM posts""",
)
def c14_posts(spark, folder):
    posts = t.posts(spark, folder)
    return threads.number_posts(posts, order=[F.desc("top"), "post_id"]).select("post_id", "subreddit", "post_counter")


@query("c15_positions", f"{t.WITH_COMMENTS} SELECT comment_id, row_number() OVER (ORDER BY comment_id) - 1 AS int_id FROM comments")
def c15(spark, folder):
    return order.with_positions(t.comments(spark, folder).select("comment_id"), ["comment_id"], "int_id")


@query(
    "c16_conform_types",
    f"""{t.WITH_COMMENTS} SELECT {FIVE} FROM comments UNION ALL
    SELECT CAST(doc_id AS STRING), 'p' || CAST(doc_id % 97 AS STRING), source, text, n_chars FROM documents""",
)
def c16(spark, folder):
    stored = t.table(spark, folder, "documents").select(
        F.col("n_chars").cast("decimal(12,0)").alias("upvotes"),
        F.col("doc_id").alias("comment_id"),
        F.concat(F.lit("p"), (F.col("doc_id") % 97).cast("string")).alias("post_id"),
        F.col("source").alias("subreddit"),
        "text",
    )
    return t.comments(spark, folder).unionByName(clean.conform(stored, COMMENT_SCHEMA))


# Tallies ---------------------------------------------------------------------------------------------

_COUNTS = f"{t.WITH_COMMENTS}, counts AS (SELECT subreddit, count(*) AS n FROM comments GROUP BY subreddit)"


@query("g1_count_by_forum", f"{_COUNTS} SELECT subreddit, n FROM counts")
def g1(spark, folder):
    return tally.count_by(t.comments(spark, folder))


@query("g2_shares", f"{_COUNTS} SELECT subreddit, n, round(n / sum(n) OVER (), 6) AS share FROM counts")
def g2(spark, folder):
    counts = tally.shares(tally.count_by(t.comments(spark, folder)))
    return counts.withColumn("share", F.round("share", 6))


@query(
    "g3_total_row",
    f"""{_COUNTS} SELECT subreddit, n, 0 AS is_total FROM counts
    UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT), 1 FROM counts""",
)
def g3(spark, folder):
    return tally.with_total(tally.count_by(t.comments(spark, folder)))


@query("g4_sorted_tally", f"{_COUNTS} SELECT subreddit, n FROM counts ORDER BY n DESC, lower(subreddit), subreddit")
def g4(spark, folder):
    return tally.by_size(tally.count_by(t.comments(spark, folder)))


@query("g4_sorted_by_name", f"{_COUNTS} SELECT subreddit, n FROM counts ORDER BY lower(subreddit), subreddit")
def g4_name(spark, folder):
    return tally.by_name(tally.count_by(t.comments(spark, folder)))


@query(
    "g5_null_counts",
    f"""{t.WITH_RAW} SELECT 'subreddit' AS "column", count(*) FILTER (subreddit IS NULL) AS n_nulls FROM raw_comments
    UNION ALL SELECT 'post_id', count(*) FILTER (post_id IS NULL) FROM raw_comments
    UNION ALL SELECT 'upvotes', count(*) FILTER (upvotes IS NULL) FROM raw_comments
    UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM raw_comments""",
)
def g5(spark, folder):
    return tally.null_counts(t.raw_comments(spark, folder))


@query(
    "g6_formatted_tally",
    f"""{_COUNTS}, rows_ AS (SELECT subreddit, n FROM counts UNION ALL SELECT 'total', sum(n) FROM counts)
    SELECT subreddit, format('{{:,}}', CAST(n AS BIGINT)) AS n,
      printf('%.2f', 100 * n / (SELECT sum(n) FROM counts)) || '%' AS pct FROM rows_""",
)
def g6(spark, folder):
    return tally.report(t.comments(spark, folder))


# Series ----------------------------------------------------------------------------------------------


@query(
    "g7_mean_and_std",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
    FROM events GROUP BY event_type""",
)
def g7(spark, folder):
    out = series.mean_and_std(t.table(spark, folder, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "g8_histogram",
    """WITH e AS (SELECT floor(min(value)) AS lo, ceil(max(value)) AS hi FROM events),
    k AS (SELECT lo, hi, CAST((hi - lo) * 4 AS BIGINT) AS k, (hi - lo) / ((hi - lo) * 4) AS w FROM e),
    c AS (SELECT least(CAST(floor((value - lo) / w) AS BIGINT), k - 1) AS bin, count(*) AS n FROM events, k GROUP BY 1),
    f AS (SELECT unnest(range(k)) AS bin, lo, w FROM k)
    SELECT f.bin, round(lo + f.bin * w, 6) AS lower, round(lo + (f.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n
    FROM f LEFT JOIN c ON f.bin = c.bin""",
)
def g8(spark, folder):
    out = series.histogram(t.table(spark, folder, "events"), "value")
    return out.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


@query(
    "g8_occupied_bins",
    """SELECT CAST(floor(value / 0.25) AS BIGINT) AS bin, floor(value / 0.25) * 0.25 AS lower,
      (floor(value / 0.25) + 1) * 0.25 AS upper, count(*) AS n FROM events GROUP BY ALL""",
)
def g8_occupied(spark, folder):
    return series.occupied_bins(t.table(spark, folder, "events"), "value", 0.25)


_ROLLING = """WITH r AS (SELECT event_id, event_type, value,
    CASE WHEN row_number() OVER w >= 3
      THEN avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END
      AS rolling
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


@query("g9_rolling_mean", f"{_ROLLING} SELECT event_id, event_type, round(rolling, 6) AS rolling FROM r")
def g9(spark, folder):
    events = t.table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    out = series.rolling_mean(events, "event_type", ["ts", "event_id"], "value", 3, "rolling", chunk=1024)
    return out.select("event_id", "event_type", F.round("rolling", 6).alias("rolling"))


@query(
    "g10_compare_series",
    """SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 6) AS delta, l_tax - l_discount > 0 AS first_is_less,
    l_tax - l_discount < 0 AS second_is_less FROM lineitem""",
)
def g10(spark, folder):
    lines = t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    out = series.compare(lines, "l_discount", "l_tax")
    return out.select(
        "l_orderkey", "l_linenumber", F.round("delta", 6).alias("delta"), "first_is_less", "second_is_less"
    )


_DRAWS = f"""SELECT i AS draw, ({t.sql_hash("'42:' || i")} // 2 * 2147483648 + {t.sql_hash("'42b:' || i")} // 2) %
    (SELECT count(*) FROM events) AS pos FROM range((SELECT count(*) FROM events)) AS x(i)"""


@query(
    "g11_sample_with_replacement",
    f"""WITH placed AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events),
    draws AS ({_DRAWS}) SELECT draw, event_id, value FROM draws JOIN placed USING (pos)""",
)
def g11(spark, folder):
    events = t.table(spark, folder, "events").select("event_id", "value")
    return series.sample_with_replacement(events, events.count(), ["event_id"], 42)


@query("g12_per_forum_processing", f"{t.WITH_COMMENTS} SELECT * REPLACE (lower(text) AS text) FROM comments")
def g12(spark, folder):
    schema = T.StructType(COMMENT_SCHEMA.fields)
    return series.per_batch(t.comments(spark, folder), _lowered, schema)


def _lowered(batch):
    return batch.assign(text=batch["text"].str.lower())
