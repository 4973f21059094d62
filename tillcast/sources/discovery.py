"""Which files are new, changed or gone since the last look, from a stored log of seen files.

The log is a folder of snapshots, ``look=0``, ``look=1`` and so on; each holds every file of its
look with path, length and modification time. A look compares a listing with the last snapshot and
becomes the next one only when it is committed, after its files have been worked on: a run that
breaks off in between sees the same changes again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.session import materialize

LOG = "path string, length bigint, modified timestamp"
#: New files up to which one scan gets them by name.
NAMED_FILES = 10_000


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the Parquet files below a folder; no file is opened."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        .load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    )


def folder_unit(path: Column | str, parts: list[str]) -> Column:
    """The year=/month=/day= folders of a file as one number, yyyymmdd; null if one of ``parts`` is missing.

    A month's number ends in 00.
    """
    path = F.col(path) if isinstance(path, str) else path
    value = [F.regexp_extract(path, rf"/{name}=(\d+)/", 1).try_cast("int") if name in parts else F.lit(0) for name in ("year", "month", "day")]
    return value[0] * 10_000 + value[1] * 100 + value[2]


def looks(spark: SparkSession, log: str) -> list[int]:
    """Numbers of the committed snapshots, ascending; one small folder name each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("look=") and system.exists(done):
            found.append(int(name.removeprefix("look=")))
    return sorted(found)


def seen(spark: SparkSession, log: str) -> DataFrame:
    """The last snapshot; empty before the first."""
    done = looks(spark, log)
    if not done:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{log}/look={done[-1]}")


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, length, modified, change) of all files of both; change is new, changed, gone or same.

    A file is changed if its length or its time differs. One that has disappeared is gone, with the
    length and time it had.
    """
    a = now.select("path", F.struct("length", "modified").alias("now"))
    b = before.select("path", F.struct("length", "modified").alias("was"))
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone")
        .when(F.col("now") == F.col("was"), "same").otherwise("changed")
    )
    return a.join(b, "path", "full").select("path", F.coalesce("now", "was").alias("f"), change.alias("change")).select(
        "path", "f.length", "f.modified", "change"
    )


def discover(spark: SparkSession, path: str, log: str) -> DataFrame:
    """All files below ``path`` against the log, stored, so that a later change of the folder does not show."""
    return materialize(compare(listing(spark, path), seen(spark, log)), "discovered")


def commit(found: DataFrame, log: str) -> int:
    """Make a comparison's files the next snapshot; returns its number."""
    spark = found.sparkSession
    number = (looks(spark, log) or [-1])[-1] + 1
    kept = found.filter(F.col("change") != "gone").select("path", "length", "modified")
    kept.write.mode("overwrite").parquet(f"{log}/look={number}")
    return number


def scan_changed(spark: SparkSession, found: DataFrame, schema: str, path: str) -> DataFrame:
    """The rows of new and changed files, with ``file``, the path they came from.

    Up to ``NAMED_FILES`` files are opened by name, as Spark's reader holds the list of its files
    anyway. A larger delivery scans ``path`` and keeps the files by a join on their name.
    """
    wanted = found.filter(F.col("change").isin("new", "changed")).select("path")
    named = [r.path for r in wanted.limit(NAMED_FILES + 1).collect()]
    reader = spark.read.schema(schema)
    file = F.col("_metadata.file_path").alias("file")
    if not named:
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    if len(named) <= NAMED_FILES:
        rows = reader.parquet(*named)
        return rows.select("*", file)
    rows = reader.option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", file).join(wanted.withColumnRenamed("path", "file"), "file", "left_semi").select(*rows.columns, "file")
