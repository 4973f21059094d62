"""Data-quality checks over all files and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tillcast import config
from tillcast.session import materialize


def empty_files(catalog: DataFrame, filled: DataFrame) -> DataFrame:
    """Catalogued files that hold no row."""
    return catalog.join(filled.select("path"), "path", "left_anti")


def negative_values(
    df: DataFrame,
    unit: str | Column = "date",
    columns: tuple[str, ...] = ("quantity_sold", "revenue"),
) -> DataFrame:
    """Units (a file or a day) in which a column has a negative minimum.

    Pass ``F.col("_metadata.file_path")`` as the unit to check per file.
    """
    unit = F.col(unit) if isinstance(unit, str) else unit
    lows = df.groupBy(unit.alias("unit")).agg(*[F.min(c).cast("double").alias(c) for c in columns])
    return (
        lows.unpivot("unit", list(columns), "column", "min_value")
        .filter(F.col("min_value") < 0)
    )


def quality_summary(
    df: DataFrame,
    unit: str | Column = "date",
    columns: tuple[str, ...] = ("quantity_sold", "revenue"),
    extra_issues: DataFrame | None = None,
) -> DataFrame:
    """One row: units checked, rows and issues. The issues themselves stay a table."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    per_unit = df.groupBy(unit.alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in columns]
    )
    issues = sum((F.when(F.col(c) < 0, 1).otherwise(0) for c in columns), F.lit(0))
    summary = per_unit.agg(
        F.count(F.lit(1)).alias("total_files_checked"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(issues), F.lit(0)).alias("total_issues"),
    )
    if extra_issues is None:
        return summary
    more = extra_issues.agg(F.count(F.lit(1))).scalar()
    return summary.withColumn("total_issues", F.col("total_issues") + more)


def quality_report(
    df: DataFrame, unit: str | Column = "date", columns: tuple[str, ...] = ("quantity_sold", "revenue")
) -> DataFrame:
    """The issues as (unit, column, min_value), each with the totals of the check.

    One row without an issue stands for a check that found none.
    """
    unit = F.col(unit) if isinstance(unit, str) else unit
    per_unit = df.groupBy(unit.cast("string").alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).cast("double").alias(c) for c in columns]
    )
    broken = sum((F.when(F.col(c) < 0, 1).otherwise(0) for c in columns), F.lit(0))
    # the totals are taken while the units are stored, and only the units with an issue are read again
    watched = Observation()
    per_unit = materialize(per_unit.withColumn("broken", broken).observe(
        watched, F.count(F.lit(1)).alias("units"), F.sum("n").alias("rows"), F.sum("broken").alias("issues")
    ), "units")
    seen = watched.get
    totals = [
        F.lit(seen["units"]).cast("bigint").alias("total_units"), F.lit(seen["rows"] or 0).cast("bigint").alias("total_rows"),
        F.lit(seen["issues"] or 0).cast("bigint").alias("total_issues"),
    ]
    if not seen["issues"]:
        none = df.sparkSession.range(1)
        return none.select(
            F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("column"),
            F.lit(None).cast("double").alias("min_value"), *totals,
        )
    issues = per_unit.filter("broken > 0").unpivot("unit", list(columns), "column", "min_value")
    return issues.filter(F.col("min_value") < 0).select("unit", "column", "min_value", *totals)


def value_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside the allowed range and nulls, per column, in one pass."""
    ranges = ranges or config.VALUE_RANGES
    counts = []
    for name, (low, high) in ranges.items():
        inside = F.col(name).between(low, high)
        counts.append(F.count(F.when(~inside, 1)).alias(f"{name}__outside"))
        counts.append(F.count(F.when(F.col(name).isNull(), 1)).alias(f"{name}__nulls"))
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(float(lo)).alias("min_allowed"),
            F.lit(float(hi)).alias("max_allowed"),
            F.col(f"{n}__outside").alias("outside"),
            F.col(f"{n}__nulls").alias("nulls"),
        )
        for n, (lo, hi) in ranges.items()
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
