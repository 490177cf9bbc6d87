"""Streams that stop and go on: restart from the checkpoint, late rows, state that is forgotten."""

import datetime

from forumloom.operators import clean
from forumloom.operators.normalizing import normalize_text
from forumloom.sources import readers
from forumloom.streaming import incremental

SCHEMA = "comment_id string, post_id string, subreddit string, text string, upvotes long"


def rows(spark, first, last):
    made = [(str(i), "p", f"f{i % 2}", f"Text  {i}" if i % 5 else "[deleted]", i) for i in range(first, last)]
    return spark.createDataFrame(made, SCHEMA)


def test_preprocessing_goes_on_where_it_stopped(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for first, last in ((0, 10), (10, 25)):  # a second run with more files
        rows(spark, first, last).write.mode("append").parquet(source)
        incremental.preprocess_stream(incremental.comment_stream(spark, source, 1), target, progress).awaitTermination()
    want = rows(spark, 0, 25).transform(clean.clean).transform(normalize_text)
    columns = want.columns
    assert sorted(map(tuple, readers.read_comments(spark, target).select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_ids_are_forgotten_behind_the_watermark(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    batches = [
        [("a", day(0)), ("a", day(0)), ("b", day(0))],
        [("a", day(1)), ("c", day(10))],  # a again, still known
        [("d", day(30))],
        [("late", day(2)), ("a", day(40)), ("d", day(31))],  # too late; forgotten and new; still known
    ]
    states = []
    for batch in batches:  # a restart for each
        spark.createDataFrame(batch, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = incremental.write_stream(incremental.distinct_comments(stream, "id", "ts", "5 days"), target, progress)
        query.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = sorted((r.id, r.ts.day + 31 * (r.ts.month - 1) - 1) for r in spark.read.parquet(target).collect())
    assert found == [("a", 0), ("a", 40), ("b", 0), ("c", 10), ("d", 30)]
    assert max(states) <= 4 and states[-1] < 4
