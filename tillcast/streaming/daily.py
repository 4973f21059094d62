"""The store-day roll-up over sales files that arrive in dated folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillcast.operators.facts import exact_sum, has_keys, joined, limbs
from tillcast.plans.refresh import unit_number
from tillcast.session import materialize
from tillcast.sources import sinks

#: Files that a batch takes, and days after which a day counts as finished.
FILES_PER_BATCH = 1000
LATENESS_DAYS = 7


def read_sales_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """New Parquet files below ``path``, so many in each batch."""
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def stream_store_day(sales: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Sales per day and store; a day is final once the watermark has passed it."""
    keys = ["date", "store_id", "product_id", "category"]
    return (
        has_keys(sales, keys)
        .withColumn("day", F.col("date").cast("timestamp"))
        .withWatermark("day", lateness)
        .groupBy("day", "store_id")
        .agg(
            F.coalesce(F.sum("quantity_sold"), F.lit(0)).alias("quantity_sold"),
            exact_sum("revenue"),
            exact_sum("profit"),
        )
        .withColumnRenamed("revenue", "sales")
    )


def write_stream(daily: DataFrame, path: str, checkpoint: str):
    """Append final days to a Parquet table; a restart continues from the checkpoint."""
    return (
        daily.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


_KEYS = ["date", "store_id", "product_id", "category"]
_SUMS = ["quantity_sold", "revenue_whole", "revenue_units", "profit_whole", "profit_units", "n"]


def deliver_batch(
    rows: DataFrame, batch: int, path: str, lateness_days: int = LATENESS_DAYS, unit: str = "day"
) -> None:
    """Add one batch of sales to the daily table below ``path``; the same batch again changes nothing.

    A batch's sums per day and store are stored as its own part of each day it touches (of each
    month, with ``unit="month"``), and these are added up again from all their parts and replace
    their partitions. So a row that comes
    late, however late, lands in its day, and a batch that is repeated after a failure overwrites its
    own parts. A count of the batch's rows is stored too: those without a key, which belong to no
    day, and those that came after their day counted as finished.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("has_keys", sum((F.col(k).isNull().cast("int") for k in _KEYS), F.lit(0)) == 0)
    money = {f"{c}_{part}": limb for c in ("revenue", "profit") for part, limb in zip(("whole", "units"), limbs(c))}
    sums = materialize(
        keyed.groupBy("has_keys", "date", "store_id").agg(
            F.coalesce(F.sum("quantity_sold"), F.lit(0)).alias("quantity_sold"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in money.items()], F.count(F.lit(1)).alias("n"),
        ), "batch",
    )
    before = _counts(spark, path)
    horizon = None
    if before is not None:
        last = before.filter(F.col("batch") < batch).agg(F.max("last_date")).first()[0]
        horizon = last - dt.timedelta(days=lateness_days) if last else None
    late = F.col("date") <= F.lit(horizon) if horizon else F.lit(False)
    sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~F.col("has_keys"), F.col("n"))), F.lit(0)).alias("without_key"),
        F.coalesce(F.sum(F.when(F.col("has_keys") & late, F.col("n"))), F.lit(0)).alias("late"),
        F.max(F.when(F.col("has_keys"), F.col("date"))).alias("last_date"),
    ).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")

    known = sums.filter("has_keys").drop("has_keys")
    number = unit_number(unit, "date")
    units = [r.unit for r in known.select(number.alias("unit")).distinct().collect()]  # at most one a calendar day
    if not units:
        return
    (
        known.withColumns({"unit": number, "batch": F.lit(batch)}).repartition("unit")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit", "batch").parquet(f"{path}/parts")
    )
    schema = T.StructType([known.schema[c] for c in ("date", "store_id", *_SUMS)]).add("unit", T.IntegerType()).add("batch", T.LongType())
    parts = spark.read.schema(schema).parquet(f"{path}/parts")
    touched = parts.filter(F.col("unit").isin(units)).groupBy("date", "store_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    daily = touched.select(
        "date", "store_id", "quantity_sold", joined(F.col("revenue_whole"), F.col("revenue_units")).alias("sales"),
        joined(F.col("profit_whole"), F.col("profit_units")).alias("profit"), F.col("n").alias("rows"),
    )
    sinks.write_by_unit(daily, f"{path}/daily", unit)


def _counts(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("rows bigint, without_key bigint, late bigint, last_date date, batch bigint").parquet(f"{path}/counts")


def deliver_daily(
    sales: DataFrame, path: str, checkpoint: str, lateness_days: int = LATENESS_DAYS, unit: str = "day"
):
    """Run the stream over all files that are there; a restart continues from the checkpoint."""
    return (
        sales.writeStream.foreachBatch(lambda rows, batch: deliver_batch(rows, batch, path, lateness_days, unit))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_delivered(spark: SparkSession, path: str, lateness_days: int = LATENESS_DAYS) -> DataFrame:
    """The daily table with ``finished``: whether the newest day is more than the lateness past it."""
    last = _counts(spark, path).agg(F.max("last_date")).first()[0]
    finished = F.date_add("date", lateness_days) <= F.lit(last)
    return spark.read.parquet(f"{path}/daily").drop("year", "month", "day").withColumn("finished", finished)


def delivery_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows, rows without a key and late rows of every batch."""
    return _counts(spark, path).select("batch", "rows", "without_key", "late", "last_date")
