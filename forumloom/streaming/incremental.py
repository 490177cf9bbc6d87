"""The same operators on a stream of arriving comment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forumloom.operators import clean
from forumloom.operators.normalizing import Step, normalize_text
from forumloom.schema import COMMENT_SCHEMA, FORUM, KEY, TEXT


def comment_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """Comment files as they arrive below a folder."""
    reader = spark.readStream.schema(COMMENT_SCHEMA).option("pathGlobFilter", "*.{parquet,parquet.gz}")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def preprocess_stream(
    stream: DataFrame, target: str, progress: str, step: Step = normalize_text, text: str = TEXT
) -> StreamingQuery:
    """Clean and normalise what has arrived, then stop. Run again to continue where it ended.

    ``progress`` keeps which files are done, so a failed run repeats nothing that was written.
    """
    return (
        stream.transform(clean.clean, text)
        .transform(step, text)
        .writeStream.format("parquet")
        .partitionBy(FORUM)
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def distinct_comments(stream: DataFrame, key: str = KEY, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Drop ids seen before. With an event time, ids are forgotten after ``delay`` and state stays bounded."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_stream(stream: DataFrame, target: str, progress: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def running_tally(stream: DataFrame, target: str, progress: str, group: str = FORUM) -> StreamingQuery:
    """Counts per forum, rewritten in full (one row per forum) after each batch."""
    counts = stream.groupBy(group).agg(F.count(F.lit(1)).alias("n"))

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
