"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.llm import (
    chat,
    decontaminate,
    language,
    minhash,
    packing,
    ranking,
    repeats,
    secrets,
    toxicity,
    trie,
    urls,
    vectors,
    warc,
)
from forumloom.llm.common import held_out, learnable
from forumloom.llm.oracles import ORACLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.train_profiles(docs.where(learnable()))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op5_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("covered", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"),
        (F.size("covered") > 0).alias("contaminated"),
    )


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SPAM_HOSTS = r"^(?:[^.]+\.)*spam-farm\."


def op8_filter_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The block list is the canonical URLs that the crawl itself saw on hosts named like link farms."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    spam = pages.where(host.rlike(SPAM_HOSTS)).select(urls.canonical(host, path).alias("url"))
    return urls.filter_urls(pages, URL_RULES, spam).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(F.encode(text(of(*secrets.BASE)), "UTF-8"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    formatted = chat.format_conversations(rows.unionByName(probe))
    return chat.read_back(formatted, "conv_id", ["turn", "position", "role", "piece"])


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_sequences, op2_language_id, op3_substring_dedup, op4_near_vectors, op5_warc_archive, op6_decontaminate,
        op7_near_duplicates, op8_filter_urls, op9_toxicity, op10_secret_scan, op11_chat_format, op12_ranked_search,
        op13_prefix_trie,
    )
}
CHECKS = ORACLES
