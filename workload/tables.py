"""Comment tables derived from the given tables, for Spark and as SQL text for the checks.

Whole tables and whole texts: every document becomes a comment with some markup appended, and every
label becomes a deleted, moderated or empty comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.operators import clean
from forumloom.session import staging_path
from forumloom.sources import writers

RAW_COMMENTS = """
SELECT CAST(doc_id AS STRING) AS comment_id,
       'p' || CAST(doc_id % 97 AS STRING) AS post_id,
       source AS subreddit,
       text || CASE doc_id % 11
         WHEN 0 THEN chr(10) || '    code block ' || CAST(doc_id AS STRING) || ' end' || chr(10) || 'after'
         WHEN 1 THEN chr(10) || '> quoted line' || chr(10) || '  &gt; second' || chr(10) || 'tail'
         WHEN 2 THEN ' see https://example.org/' || CAST(doc_id AS STRING) || ' and www.example.net/x end'
         WHEN 3 THEN ' run `select 1` and ``x`` now'
         WHEN 4 THEN ' A &amp; B &#8217;s &hellip; &ndash; &Prime; &amp;lt;'
         WHEN 5 THEN ' dash–one—two---three ~ tilde'
         WHEN 6 THEN ' “curly” „low” «angle» （wide）'
         WHEN 7 THEN ' it’s ‘so‛ ´odd `tick'
         WHEN 8 THEN chr(9) || 'tab' || chr(13) || chr(11) || '  two   spaces  '
         WHEN 9 THEN ' ﬁne … ½ café ™ straße'
         ELSE chr(10) || 'www.example.com/y > not a quote' || chr(10) || '&amp;lt; x &lt;' END AS text,
       n_chars AS upvotes
FROM {documents}
UNION ALL
SELECT 'm' || CAST(doc_id AS STRING), 'p' || CAST(doc_id % 97 AS STRING), 'src' || CAST(doc_id % 20 AS STRING),
       CASE WHEN toxic = 1 THEN '[removed]' WHEN quality = 0 THEN '[deleted]'
            WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN CAST(NULL AS STRING)
            WHEN doc_id % 4 = 2 THEN '"“”„' ELSE '"[deleted]"' END,
       CAST(0 AS BIGINT)
FROM {labels}
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        RAW_COMMENTS, documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels")
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean(raw_comments(spark, folder))


def refetched(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents seen again, with changed text."""
    seen = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    again = clean.keep_ids(comments(spark, folder), seen)
    return again.withColumn("text", F.concat(F.lit("edit: "), "text"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as comment trees: turn t answers turn floor((t - 1) / 2)."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("post_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.when(
            F.col("turn") > 0,
            F.concat_ws("-", F.col("conv_id").cast("string"), F.floor((F.col("turn") - 1) / 2).cast("string")),
        ).alias("parent_id"),
        F.col("turn").alias("sibling"),
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("source").alias("subreddit"),
        F.col("n_chars").alias("top"),
        (F.col("doc_id") * 7919 % 10007).alias("hot"),
    )


def multiclass(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("lang").alias("y_true"),
        F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("y_pred"),
    )


def binary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("quality").alias("y_true"),
        F.col("toxic").alias("y_pred"),
        ((F.col("doc_id") % 10 + 0.5) / 10).alias("p_true"),
    )


_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, build) -> str:
    """Path of a comment table written once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        path = staging_path(spark, name)
        writers.write_comments(build(spark, folder), path)
        _written[key] = path
    return _written[key]


# SQL side --------------------------------------------------------------------------------------------

# Unicode white space and word characters in RE2 syntax.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

_RAW = RAW_COMMENTS.format(documents="documents", labels="labels")

WITH_RAW = f"WITH RECURSIVE raw_comments AS ({_RAW})"

WITH_COMMENTS = f"""{WITH_RAW}, comments AS (
  SELECT comment_id, post_id, subreddit, regexp_replace(text, '["“”‟„⹂〞〟＂❝❞]', '', 'g') AS text, upvotes
  FROM raw_comments
  WHERE (text IS NULL OR text NOT IN ('[deleted]', '[removed]'))
    AND regexp_replace(text, '["“”‟„⹂〞〟＂❝❞]', '', 'g') <> '')"""

WITH_REFETCHED = f"""{WITH_COMMENTS}, refetched AS (
  SELECT * REPLACE ('edit: ' || text AS text) FROM comments
  WHERE comment_id IN (SELECT CAST(doc_id AS STRING) FROM labels))"""

WITH_REPLIES = """WITH RECURSIVE replies AS (
  SELECT 'c' || conv_id AS post_id, conv_id || '-' || turn AS comment_id, turn,
         CASE WHEN turn > 0 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent_id
  FROM conversations),
flat AS (
  SELECT post_id, comment_id, 0 AS depth, lpad(CAST(turn AS STRING), 19, '0') || '.' || substr(md5(comment_id), 1, 16) AS path
  FROM replies WHERE parent_id IS NULL
  UNION ALL
  SELECT r.post_id, r.comment_id, f.depth + 1, f.path || '/' || lpad(CAST(r.turn AS STRING), 19, '0') || '.' || substr(md5(r.comment_id), 1, 16)
  FROM replies r JOIN flat f ON r.post_id = f.post_id AND r.parent_id = f.comment_id)"""

WITH_POSTS = """WITH posts AS (
  SELECT CAST(doc_id AS STRING) AS post_id, source AS subreddit, n_chars AS top, doc_id * 7919 % 10007 AS hot
  FROM documents)"""

WITH_MULTICLASS = """WITH preds AS (
  SELECT CAST(doc_id AS STRING) AS comment_id, lang AS y_true,
         CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS y_pred FROM documents)"""

WITH_BINARY = """WITH preds AS (
  SELECT CAST(doc_id AS STRING) AS comment_id, quality AS y_true, toxic AS y_pred,
         (doc_id % 10 + 0.5) / 10 AS p_true FROM labels)"""


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{SPACE}]+'), lambda x: x <> '')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[{WORD}]{{2,}}')"


def sql_hash(value: str) -> str:
    """The 32-bit number in the first eight hex digits of an MD5."""
    return f"CAST('0x' || substr(md5({value}), 1, 8) AS BIGINT)"


def sql_split(source: str, key: str = "comment_id", share: str = "0.25") -> str:
    """``source`` with the exact random split."""
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || {key})) <= ceil({share} * count(*) OVER ())
      THEN 'test' ELSE 'train' END AS split FROM {source}"""
