"""Time the headline queries: one JSON line, read by the benchmark driver."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from forumloom.operators import features, normalizing, split, tally, tokens  # noqa: E402
from forumloom.session import local_session, spread  # noqa: E402
from workload import tables as t  # noqa: E402


def run(df):
    """Compute every column of every row without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def normal(spark, folder):
    return normalizing.normalize_text(spread(t.comments(spark, folder)), "text")


def with_stop_words(spark, folder):
    return tokens.remove_stop_words(normal(spark, folder))


def with_lemmas(spark, folder):
    docs = with_stop_words(spark, folder)
    words = tokens.tokens_only(t.comments(spark, folder)).distinct().where(F.col("token").endswith("s"))
    lemmas = words.select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return tokens.map_tokens(docs, lemmas)


def tfidf(spark, folder):
    parts = split.random_split(spread(t.comments(spark, folder)).select("comment_id", "text"))
    return features.tfidf_vectors(parts, features.fit_vocabulary(parts.where("split = 'train'")))


QUERIES = {
    "clean": lambda spark, folder: t.comments(spark, folder),
    "full_normalization": normal,
    "full_normalization_stop_words": with_stop_words,
    "full_normalization_stop_words_lemmas": with_lemmas,
    "tfidf": tfidf,
    "hashed": lambda spark, folder: features.hashed_vectors(spread(t.comments(spark, folder))),
    "tally": lambda spark, folder: tally.report(t.comments(spark, folder)),
    "null_counts": lambda spark, folder: tally.null_counts(t.raw_comments(spark, folder)),
}


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    texts = t.comments(spark, folder).count()  # also warms the session up
    seconds = {}
    for name, build in QUERIES.items():
        start = time.perf_counter()
        run(build(spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "texts": texts,
                "texts_per_second": {
                    name: round(texts / seconds[name], 1) for name in seconds if name.startswith("full_normalization")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
