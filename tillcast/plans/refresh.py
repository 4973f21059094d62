"""Refresh of the daily store table for the days whose files have changed, and no others.

Inputs and table lie in folders of days; with ``unit="month"`` in folders of months, and a month is
what is recomputed and replaced. Units go by their number, yyyymmdd, with 00 for a month's day.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast import schemas
from tillcast.plans.daily import daily_store_sales
from tillcast.session import materialize
from tillcast.sources import discovery, sinks

#: Changed units up to which they reach the scans as a list; more of them go as their first and last day.
LISTED_UNITS = 1_000


@dataclass
class Inputs:
    """Folders of dated files (year=/month=/day=) of each kind; promotions and traffic may be absent.

    ``unit`` tells whether the files lie in folders of days or of months.
    """

    sales: str
    promotions: str | None = None
    traffic: str | None = None
    schemas: dict[str, str] = field(default_factory=lambda: {
        "sales": schemas.SALES, "promotions": schemas.PROMOTIONS, "traffic": schemas.CUSTOMER_TRAFFIC,
    })
    unit: str = "day"

    def folders(self) -> dict[str, tuple[str, str]]:
        made = {"sales": self.sales, "promotions": self.promotions, "traffic": self.traffic}
        return {name: (path, self.schemas[name]) for name, path in made.items() if path}


def touched(found: dict[str, DataFrame], unit: str = "day") -> list[int]:
    """Units with a new, changed or vanished file of any kind: at most one a calendar day."""
    units = None
    for files in found.values():
        dated = files.filter(F.col("change") != "same").select(discovery.folder_unit("path", sinks.UNITS[unit]).alias("unit"))
        units = dated if units is None else units.unionByName(dated)
    numbers = [r.unit for r in units.distinct().collect()]
    if None in numbers:
        raise ValueError(f"a changed file lies outside the {'/'.join(sinks.UNITS[unit])} folders")
    return sorted(numbers)


def unit_number(unit: str = "day", date: str | None = None) -> Column:
    """A unit's number from the folder columns, or from a date column."""
    made = {p: F.col(p) if date is None else getattr(F, p)(date) for p in sinks.UNITS[unit]}
    return made["year"] * 10_000 + made["month"] * 100 + made.get("day", F.lit(0))


def scan_units(spark: SparkSession, path: str, schema: str, units: list[int], unit: str = "day") -> DataFrame:
    """The rows of the given days or months; only their folders are listed for reading."""
    folders = sinks.UNITS[unit]
    facts = spark.read.schema(f"{schema}, {', '.join(f'{c} int' for c in folders)}").parquet(path)
    if len(units) <= LISTED_UNITS:
        facts = facts.filter(unit_number(unit).isin(units))
    else:  # wider than the list, so the units are looked up again
        wanted = spark.createDataFrame([(d,) for d in units], "__unit int")
        facts = facts.filter(unit_number(unit).between(units[0], units[-1])).withColumn("__unit", unit_number(unit))
        facts = facts.join(F.broadcast(wanted), "__unit", "left_semi").drop("__unit")
    return facts.drop(*folders)


def refresh_daily(spark: SparkSession, inputs: Inputs, target: str, log: str, **options) -> list[int]:
    """Bring the daily table below ``target`` up to date; returns the units that were recomputed.

    The listing of every input is compared with the stored log. Days with a changed file are
    computed anew from all their files and replace their own partitions; a day that has lost all its
    files loses its partition. The log is written last, so a run that breaks off is repeated as a
    whole, with the same result. A row belongs to the day of its folder: rows whose date differs
    from it are an error, since another day's partition would silently lack them.
    """
    unit = inputs.unit
    found = {name: discovery.discover(spark, path, f"{log}/{name}") for name, (path, _) in inputs.folders().items()}
    units = touched(found, unit)
    if units:
        tables = {name: scan_units(spark, path, schema, units, unit) for name, (path, schema) in inputs.folders().items()}
        daily = daily_store_sales(tables["sales"], tables.get("promotions"), tables.get("traffic"), **options)
        daily = materialize(daily, "refreshed")
        made = {r.unit for r in daily.select(unit_number(unit, "date").alias("unit")).distinct().collect()}
        if made - set(units):
            raise ValueError(f"rows of other days in the folders of the changed ones: {sorted(made - set(units))[:5]}")
        if made:
            sinks.write_by_unit(daily, target, unit)
        for number in sorted(set(units) - made):
            parts = dict(zip(("year", "month", "day"), (number // 10_000, number // 100 % 100, number % 100)))
            _remove(spark, "/".join([target, *(f"{c}={parts[c]}" for c in sinks.UNITS[unit])]))
    for name, files in found.items():
        discovery.commit(files, f"{log}/{name}")
    return units


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path):
        system.delete(path, True)


def read_daily(spark: SparkSession, target: str) -> DataFrame:
    """The daily table without its folder columns."""
    return spark.read.parquet(target).drop("year", "month", "day")
