"""Queries over streams: each runs to the end of the available files and reads its output back."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumloom.operators import clean
from forumloom.session import staging_path
from forumloom.sources import readers
from forumloom.streaming import incremental
from workload import tables as t
from workload.registry import query
from workload.text_queries import NORMAL


FILE_ROWS = 20_000
"""Comments in a file, about; small tables make three files."""


def _files(spark, folder, build=t.raw_comments):
    """Comments in several files, as a crawler would leave them, and how many of them arrive together."""
    path = staging_path(spark, "arriving")
    rows = build(spark, folder)
    files = max(3, rows.count() // FILE_ROWS)
    rows.repartition(files).write.parquet(path)
    return path, -(-files // 3)


@query(
    "st1_incremental_preprocessing",
    f"""{t.WITH_COMMENTS}, normal AS ({NORMAL})
    SELECT comment_id, post_id, subreddit, normal.text AS text, upvotes FROM comments JOIN normal USING (comment_id)""",
)
def st1(spark, folder):
    target, progress = staging_path(spark, "stream"), staging_path(spark, "progress")
    stream = incremental.comment_stream(spark, *_files(spark, folder))
    incremental.preprocess_stream(stream, target, progress).awaitTermination()
    return readers.read_comments(spark, target)


@query("st2_stream_distinct_ids", f"{t.WITH_COMMENTS} SELECT DISTINCT comment_id FROM comments")
def st2(spark, folder):
    def twice(spark, folder):
        return t.comments(spark, folder).unionByName(t.refetched(spark, folder))

    target, progress = staging_path(spark, "stream"), staging_path(spark, "progress")
    stream = incremental.comment_stream(spark, *_files(spark, folder, twice))
    incremental.write_stream(incremental.distinct_comments(stream), target, progress).awaitTermination()
    return spark.read.parquet(target).select("comment_id")


@query("st2_stream_distinct_events", "SELECT event_id, user_id, event_type FROM events")
def st2_events(spark, folder):
    """Events that arrive twice, a third of the time span after the other: ids are forgotten behind the watermark."""
    events = t.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    arriving, share = staging_path(spark, "arriving"), F.lit(3) * (F.col("ts").cast("double") - F.lit(low).cast("double"))
    third = F.floor(share / (F.lit(high).cast("double") - F.lit(low).cast("double") + 1))
    for part in range(3):
        own = events.where(third == part)
        own.unionByName(own).write.mode("append").parquet(arriving)
    target, progress = staging_path(spark, "stream"), staging_path(spark, "progress")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    distinct = incremental.distinct_comments(stream, "event_id", "ts", "400 days")
    incremental.write_stream(distinct, target, progress).awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type")


@query("st3_running_tally", f"{t.WITH_COMMENTS} SELECT subreddit, count(*) AS n FROM comments GROUP BY subreddit")
def st3(spark, folder):
    target, progress = staging_path(spark, "stream"), staging_path(spark, "progress")
    stream = clean.clean(incremental.comment_stream(spark, *_files(spark, folder)))
    incremental.running_tally(stream, target, progress).awaitTermination()
    return spark.read.parquet(target).select("subreddit", F.col("n"))
