"""Columns of the caller named like inner ones, extreme vectors, many lengths, the URL filter's size."""

from pyspark.sql import functions as F

from forumloom.llm import decontaminate, language, minhash, toxicity, urls, vectors
from forumloom.llm.common import stage


def test_inner_names_of_the_caller_stay(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat on the mat", "g", "r", "s", 0.5, 7)],
        "doc_id long, text string, _guess string, _row string, _score string, score double, predicted int",
    )
    profiles = language.train_profiles(docs.withColumn("lang", F.lit("en")))
    found = language.identify(docs, profiles).first()
    assert (found["_guess"], found["_row"], found["_score"], found["lang_pred"]) == ("g", "r", "s", "en")
    bench = spark.createDataFrame([(i, f"w{i} x y z") for i in range(30)], "item_id long, text string")
    hit = decontaminate.find_contamination(docs, bench, block_bytes=40).first()
    assert (hit["_row"], hit["_guess"], hit["score"], hit["items"]) == ("r", "g", 0.5, [])
    pages = spark.createDataFrame(
        [(1, "http://a.b/c", "l", "u", "k", "w", "m", "r")],
        "page_id long, url string, _listed string, _url string, _block string, _word string, _maybe string, _row string",
    )
    listed = spark.createDataFrame([("a.b/c",)], "url string")
    row = urls.filter_urls(pages, [], listed).first()
    assert (row["_listed"], row["_url"], row["_block"], row["_word"], row["_maybe"], row["_row"], row["verdict"]) == (*"luk", *"wmr", "block")


def test_toxicity_replaces_its_own_columns(spark):
    docs = spark.createDataFrame([(i, "you bad awful thing" if i % 2 else "a nice calm day") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    clash = docs.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit("p")).withColumn("_score", F.lit("q"))
    found = toxicity.score(clash, model)
    assert dict(found.dtypes)["score"] == "double" and dict(found.dtypes)["predicted"] == "int"
    assert {r["_score"] for r in found.collect()} == {"q"}


def test_large_and_small_components_and_many_lengths(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308])]
    rows += [(7, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 0.0])]
    rows += [(100 + n, [1.0] * n) for n in range(3, 83)] + [(200 + n, [2.0] * n) for n in range(3, 83)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert {i: found[i] for i in range(1, 10)} == {
        1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9)
    }
    assert all(found[100 + n] == (1, 100 + n) == found[200 + n] for n in range(3, 83))


def test_the_filter_grows_with_its_list(spark):
    listed = spark.range(40_000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("u"))
    blocks = 1 << (40_000 // urls.PER_BLOCK).bit_length()
    bloom = urls.bloom_filter(listed, "u", blocks)
    other = spark.range(20_000).select(F.concat(F.lit("z.net/"), F.col("id").cast("string")).alias("u"))
    passed = urls.may_contain(other, "u", bloom, blocks).where("_maybe").count()
    assert passed < 0.02 * 20_000 and urls.may_contain(listed, "u", bloom, blocks).where("NOT _maybe").count() == 0


def test_blocks_return_fewer_links_than_rows(spark):
    """One group of 150 near copies: its dense postings hold thousands of pairs, the blocks return joining links only."""
    base = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(w if k != i % 120 else f"c{i}" for k, w in enumerate(base))) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = stage(minhash.signatures(docs))
    reps = stage(sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature", "longer"))
    posted = minhash.postings(reps).withColumn("c", F.col("id"))
    links = minhash.linked_in_blocks(posted, reps, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), 5, 75)
    found, postings = links.count(), posted.select("coord", "value").distinct().count()
    assert 149 <= found <= posted.count() - postings
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}
