"""Writing comment tables, splits, features and predictions as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.operators.clean import keep_ids, merge_comments
from forumloom.schema import COMMENT_SCHEMA, FORUM, KEY, TEXT
from forumloom.session import staging_path
from forumloom.sources.readers import read_comments

COMPRESSION = "gzip"


def _partitioned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gather rows by partition column; the rebalance hint splits a large forum over several files and
    joins small ones, by the sizes seen at run time."""
    return df.hint("rebalance", *columns)


def write_comments(
    comments: DataFrame, path: str, partition_by: Sequence[str] = (FORUM,), mode: str = "error"
) -> None:
    """Gzip Parquet below ``subreddit=`` folders.

    A second level by ``post_id`` is possible but makes one folder per post; leave it out for large forums.
    """
    (
        _partitioned(comments, partition_by)
        .write.mode(mode)
        .option("compression", COMPRESSION)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def upsert_comments(new: DataFrame, path: str, partition_by: Sequence[str] = (FORUM,)) -> None:
    """Merge new comments into a stored table: new rows win, only forums that received rows are rewritten.

    The merged forums are staged in the shared folder before they replace the folders they were read
    from. A comment is expected to stay in its post.
    """
    spark = new.sparkSession
    new = new.select(*[f.name for f in COMMENT_SCHEMA])
    if not table_exists(spark, path):
        write_comments(merge_comments(new, new.limit(0)), path, partition_by)
        return
    touched = new.select(FORUM).distinct()
    existing = read_comments(spark, path).join(touched, FORUM, "left_semi")  # prunes folders at run time
    stage = staging_path(spark, "merge")
    merge_comments(new, existing).write.parquet(stage)
    (
        _partitioned(spark.read.parquet(stage), partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_ids(split: DataFrame, path: str, key: str = KEY, mode: str = "error") -> None:
    """The ids of each split, one folder per split."""
    split.where(F.col("split").isNotNull()).select(key, "split").write.mode(mode).partitionBy("split").parquet(path)


def write_features(features: DataFrame, path: str, mode: str = "error") -> None:
    """Long features with a ``split`` column, one folder per split."""
    features.write.mode(mode).partitionBy("split").option("compression", COMPRESSION).parquet(path)


def write_split_texts(
    texts: DataFrame, ids: DataFrame, path: str, key: str = KEY, text: str = TEXT, mode: str = "error"
) -> None:
    """Preprocessed texts of the splits ``all``, ``train`` and ``test`` in folders of their own."""
    texts = texts.select(key, text)
    texts.write.mode(mode).option("compression", COMPRESSION).parquet(f"{path}/all")
    for name in ("train", "test"):
        part = keep_ids(texts, ids.where(F.col("split") == name), key)
        part.write.mode(mode).option("compression", COMPRESSION).parquet(f"{path}/{name}")


def named_predictions(
    predictions: DataFrame, names: DataFrame, key: str = KEY, true: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """``(key, y_true, y_pred, is_correct)`` with class names for class numbers.

    ``names`` is ``(index, name)``, one row per class; Spark decides on the join by its size.
    """
    truth = names.select(F.col("index").alias(true), F.col("name").alias("_true"))
    guess = names.select(F.col("index").alias(pred), F.col("name").alias("_pred"))
    return (
        predictions.join(truth, true, "left")
        .join(guess, pred, "left")
        .select(
            key,
            F.col("_true").alias("y_true"),
            F.col("_pred").alias("y_pred"),
            (F.col(true) == F.col(pred)).cast("int").alias("is_correct"),
        )
    )


def write_predictions(predictions: DataFrame, names: DataFrame, path: str, key: str = KEY, mode: str = "error") -> None:
    named_predictions(predictions, names, key).write.mode(mode).option("compression", COMPRESSION).parquet(path)
