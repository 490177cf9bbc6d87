"""A comment table whose updates appear at once: versioned forum folders under a manifest that is written last.

``path/data/version=<n>/subreddit=<forum>/`` holds the rows of a forum as of version n, ``path/manifest/<n>/`` names the
version of every forum. A manifest counts once its ``_SUCCESS`` file is there, which Spark writes after all else, so
readers see the table before or after an update and nothing between. No file is replaced: an update writes each
touched forum once, without a staging copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.operators.clean import merge_comments
from forumloom.schema import COMMENT_SCHEMA, FORUM
from forumloom.sources.readers import PARQUET_FILES
from forumloom.sources.writers import COMPRESSION

MANIFEST_SCHEMA = f"{FORUM} string, version long"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all manifests, also of those that were never finished."""
    files, folder = _files(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """The data folder of every version number, finished or not."""
    files, data = _files(spark, f"{path}/data")
    found = [s.getPath() for s in files.listStatus(data)] if files.exists(data) else []
    return {int(p.getName().partition("=")[2]): p for p in found if p.getName().startswith("version=")}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table, oldest first."""

    def finished(number: int) -> bool:
        files, mark = _files(spark, f"{path}/manifest/{number}/_SUCCESS")
        return files.exists(mark)

    return [n for n in _numbers(spark, path) if finished(n)]


def read_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest/{version}")


def _rows(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The rows of the folders a manifest names; the join prunes folders at run time."""
    wanted = manifest.select(F.col(FORUM).alias("_forum"), F.col("version").alias("_version"))
    rows = (
        spark.read.schema(T.StructType([*COMMENT_SCHEMA.fields, T.StructField("version", T.LongType())]))
        .option("basePath", f"{path}/data")
        .option("pathGlobFilter", PARQUET_FILES)
        .parquet(f"{path}/data")
    )
    same = (F.col("version") == F.col("_version")) & F.col(FORUM).eqNullSafe(F.col("_forum"))
    return rows.join(wanted, same, "left_semi").select(*COMMENT_SCHEMA.names)


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last finished version, or of an older one that was not removed."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no finished version below {path}")
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not among {known}")
    return _rows(spark, path, read_manifest(spark, path, known[-1] if version is None else version))


def write_version(new: DataFrame, path: str) -> tuple[int, DataFrame]:
    """Write the touched forums, merged with what they hold, as the folders of a next version nobody reads yet.

    Returns its number and the manifest that would make it visible. A null forum is a forum of its own.
    """
    spark = new.sparkSession
    new = new.select(*COMMENT_SCHEMA.names)
    known = versions(spark, path)
    number = max([0, *_numbers(spark, path), *_folders(spark, path)]) + 1
    touched = new.select(F.col(FORUM).alias("_touched")).distinct()
    is_touched = F.col(FORUM).eqNullSafe(F.col("_touched"))
    if known:
        manifest = read_manifest(spark, path, known[-1])
        existing = _rows(spark, path, manifest.join(touched, is_touched, "left_semi"))
        untouched = manifest.join(touched, is_touched, "left_anti")
    else:
        existing, untouched = new.limit(0), spark.createDataFrame([], MANIFEST_SCHEMA)
    folder = f"{path}/data/version={number}"
    merged = merge_comments(new, existing)
    merged.hint("rebalance", FORUM).write.option("compression", COMPRESSION).partitionBy(FORUM).parquet(folder)
    added = touched.select(F.col("_touched").alias(FORUM), F.lit(number).cast("long").alias("version"))
    return number, untouched.unionByName(added)


def publish(manifest: DataFrame, path: str, version: int) -> None:
    """Make a written version the one that is read. Of two writers of one number the later one fails."""
    manifest.write.mode("error").parquet(f"{path}/manifest/{version}")


def upsert_versioned(new: DataFrame, path: str) -> int:
    """Merge new comments into a versioned table: new rows win, only forums that received rows are written again.

    A run that stops before the end changes nothing for readers; what it left behind goes with
    ``drop_old_versions``. ``new`` is read twice and must give the same rows each time.
    """
    version, manifest = write_version(new, path)
    publish(manifest, path, version)
    return version


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove manifests before the last ``keep`` and every folder that no kept manifest names.

    Not while an update runs: its folders are in no manifest yet. Readers of a removed version fail.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    kept = versions(spark, path)[-keep:]
    if not kept:
        return
    files, _ = _files(spark, f"{path}/manifest")
    for number in _numbers(spark, path):
        if number < kept[-1] and number not in kept:
            files.delete(_files(spark, f"{path}/manifest/{number}")[1], True)
    named = read_manifest(spark, path, kept[0])
    for version in kept[1:]:
        named = named.unionByName(read_manifest(spark, path, version))
    in_use = {r.version for r in named.select("version").distinct().collect()}  # one per update that still counts
    folder_name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for number, folder in _folders(spark, path).items():
        if number not in in_use:
            files.delete(folder, True)
            continue
        forums = named.where(F.col("version") == number).select(FORUM).distinct().toLocalIterator()
        names = {folder_name(FORUM, row[0]) for row in forums}  # folder names of one version, not its rows
        for forum in files.listStatus(folder):
            name = forum.getPath().getName()
            if name.startswith(f"{FORUM}=") and name not in names:
                files.delete(forum.getPath(), True)
