"""Texts in no known language go, and own columns stay."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_noise_and_foreign_texts_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    letters = random.Random(1)
    noise = "".join(letters.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(1000))
    foreign = "Съешь же ещё этих мягких французских булок да выпей чаю. " * 5
    planted = spark.createDataFrame([(-1, noise, None), (-2, foreign, None)], docs.schema)
    frame = docs.unionByName(planted)
    frame = frame.withColumn("score", F.col("doc_id") * 2).withColumn("lang_pred", F.lit("mine"))
    left = corpus_pipeline.known_language(spark, frame, SMALL)
    assert left.columns == frame.columns
    rows = left.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(r.score == r.doc_id * 2 and r.lang_pred == "mine" for r in rows)
