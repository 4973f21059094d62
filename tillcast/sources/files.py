"""Distributed scans of fact files and the catalogue of files behind them."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillcast import config

FOLDERS = "year int, month int, day int"


def scan_facts(
    spark: SparkSession,
    path: str,
    schema: str,
    start: str | None = None,
    end: str | None = None,
    partitioned: bool = False,
    date_as: str = "date",
) -> DataFrame:
    """Read every Parquet file below ``path`` as one table with the declared columns.

    With ``partitioned`` the year/month/day folders are discovered, so the date bounds also
    prune folders; the folder columns are dropped again because the date features reuse their
    names. Without it folders are only walked. ``date_as`` tells how the files store the date
    column: as a date, a timestamp or a nanosecond timestamp. The bounds are compared in that
    form, so they reach the row groups either way, and the result always holds a date.
    """
    stored, bound, to_date = _DATE_FORMS[date_as]
    if date_as == "nanos":
        if spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false") != "true":
            raise ValueError("nanosecond dates need spark.sql.legacy.parquet.nanosAsLong")
    file_schema = re.sub(r"\bdate date\b", f"date {stored}", schema)
    if partitioned:
        facts = spark.read.schema(f"{file_schema}, {FOLDERS}").parquet(path)
        # one number from the folder columns alone, so that the filter prunes to the day
        day = F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
        if start:
            facts = facts.filter(day >= int(start.replace("-", "")))
        if end:
            facts = facts.filter(day <= int(end.replace("-", "")))
        facts = facts.drop("year", "month", "day")
    else:
        facts = (
            spark.read.schema(file_schema).option("recursiveFileLookup", "true").parquet(path)
        )
    if start:
        facts = facts.filter(F.col("date") >= bound(dt.date.fromisoformat(start)))
    if end:
        after = dt.date.fromisoformat(end) + dt.timedelta(days=1)
        facts = facts.filter(F.col("date") < bound(after))
    return facts if date_as == "date" else facts.withColumn("date", to_date("date"))


def _nanos(day: dt.date):
    return F.lit((day - dt.date(1970, 1, 1)).days * 86_400_000_000_000)


def nanos_to_date(column: str):
    """Date from a nanosecond timestamp read as a long."""
    return F.date_add(
        F.lit("1970-01-01").cast("date"),
        F.floor(F.col(column) / F.lit(86_400_000_000_000)).cast("int"),
    )


# date form: column type in the file, literal of a bound, conversion to a date
_DATE_FORMS = {
    "date": ("date", F.lit, None),
    "timestamp": ("timestamp_ntz", lambda day: F.lit(str(day)).cast("timestamp_ntz"), F.to_date),
    "nanos": ("bigint", _nanos, nanos_to_date),
}


def file_catalog(
    spark: SparkSession,
    path: str,
    data_types: list[str] | None = None,
    endpoint: str | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """One row per Parquet file: type, key, address and size, without opening any file.

    The type is the first name of ``data_types`` contained in the key. ``content`` of the
    binary source is never selected, so only the listing is done.
    """
    types = data_types or sorted(config.DATA_TYPES)
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    root = path.rstrip("/").split("://")[-1].split(":")[-1]
    key = F.ltrim(F.substring_index(F.col("path"), root, -1), F.lit("/"))
    kind = F.lit(None).cast("string")
    for name in reversed(types):
        kind = F.when(F.contains(key, F.lit(name)), F.lit(name)).otherwise(kind)
    bucket = bucket or root.lstrip("/")
    base = endpoint.rstrip("/") if endpoint else "file:/"
    return listed.select(
        kind.alias("data_type"),
        key.alias("key"),
        F.concat(F.lit(f"{base}/{bucket}/"), key).alias("url"),
        F.concat(F.lit(f"s3://{bucket}/"), key).alias("s3_path"),
        F.col("path"),
        F.col("length").alias("bytes"),
    ).filter(F.col("data_type").isNotNull())


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Files per data type, and their total in the row of type ``total``.

    A catalogue with ``rows`` (``with_rows``) has them added up too.
    """
    counted = [F.sum("rows").alias("rows")] if "rows" in catalog.columns else []
    return (
        catalog.rollup("data_type")
        .agg(F.count(F.lit(1)).alias("files"), *counted, F.grouping("data_type").alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, "total").otherwise(F.col("data_type"))
            .alias("data_type"),
            "files",
            *(["rows"] if counted else []),
        )
    )


def with_rows(catalog: DataFrame, filled: DataFrame) -> DataFrame:
    """The catalogue with the rows of every file, 0 for an empty one."""
    return catalog.join(filled.select("path", "rows"), "path", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0))
    )


def type_coverage(found: DataFrame, expected: list[str], column: str = "data_type") -> DataFrame:
    """Each expected type with whether ``found`` holds it."""
    spark = found.sparkSession
    wanted = spark.range(1).select(
        F.explode(F.array(*[F.lit(e) for e in expected])).alias(column)
    )
    seen = found.select(column).distinct().withColumn("found", F.lit(True))
    return wanted.join(seen, column, "left").select(
        column, F.coalesce("found", F.lit(False)).alias("found")
    )


def missing_types(found: DataFrame, expected: list[str], column: str = "data_type") -> DataFrame:
    """Expected types that ``found`` lacks."""
    return type_coverage(found, expected, column).filter(~F.col("found")).select(column)


def files_with_rows(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` that hold at least one row, with their row count.

    Only the footer is needed: no data column is read.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows")
    )
