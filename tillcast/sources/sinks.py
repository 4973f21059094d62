"""Parquet and CSV sinks, dataset metadata and preprocessing parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_by_day(df: DataFrame, path: str, date_col: str = "date", mode: str = "overwrite") -> None:
    """Write facts into year/month/day folders.

    The rebalance hint groups a day into few files and lets AQE split a day that is too large
    for one task, so neither many small files nor one hot writer results.
    """
    write_by_unit(df, path, "day", date_col, mode)


#: Folder columns of a unit of replacement.
UNITS = {"day": ["year", "month", "day"], "month": ["year", "month"]}


def write_by_unit(df: DataFrame, path: str, unit: str = "day", date_col: str = "date", mode: str = "overwrite") -> None:
    """Write facts into the folders of their days or months; overwriting replaces only those written."""
    columns = {"year": F.year(date_col), "month": F.month(date_col), "day": F.day(date_col)}
    _write(df.withColumns({c: columns[c] for c in UNITS[unit]}), path, UNITS[unit], mode)


def write_by_week(df: DataFrame, path: str, date_col: str = "date", mode: str = "overwrite") -> None:
    """Write snapshots into ISO year/week folders."""
    parts = df.withColumns(
        {"year": F.expr(f"extract(YEAROFWEEK FROM {date_col})"), "week": F.weekofyear(date_col)}
    )
    _write(parts, path, ["year", "week"], mode)


def _write(df: DataFrame, path: str, keys: list[str], mode: str) -> None:
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write an unpartitioned Parquet table."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Read CSV with a declared schema; a malformed row is an error, not a null."""
    return (
        spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    )


def dataset_metadata(sales: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row about a dataset: date span, stores, products, rows and, given a catalogue, files."""
    facts = sales.agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("end_date"),
        F.count_distinct("store_id").alias("n_stores"),
        F.count_distinct("product_id").alias("n_products"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    if catalog is None:
        return facts
    counts = catalog.groupBy("data_type").agg(F.count(F.lit(1)).alias("files"))
    files = counts.agg(  # one entry per data type, a handful
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("data_type", "files"))))
        .alias("file_counts")
    )
    total = counts.agg(F.coalesce(F.sum("files"), F.lit(0)))
    written = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return facts.withColumns(
        {
            "generation_date": written,
            "file_counts": files.scalar(),
            "total_files": total.scalar(),
        }
    )


def save_params(path: str, **tables: DataFrame) -> None:
    """Save encoder codes, scaler parameters and the feature list as Parquet tables."""
    for name, table in tables.items():
        write_table(table, f"{path}/{name}")


def load_params(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
