"""Object keys of the dated folder layout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_key(data_type: str, date_col: str = "date", prefix: str | None = None) -> Column:
    """``sales/year=2025/month=01/day=02/sales_2025-01-02.parquet``"""
    return F.concat(
        F.lit(f"{data_type}/"),
        F.date_format(date_col, "'year='yyyy'/month='MM'/day='dd'/'"),
        F.lit(f"{prefix or data_type}_"),
        F.date_format(date_col, "yyyy-MM-dd"),
        F.lit(".parquet"),
    )


def key_parts(key: str) -> dict[str, Column]:
    """Top folder, file name, date in the name and whether it is Parquet."""
    column = F.col(key)
    name = F.element_at(F.split(column, "/"), -1)
    return {
        "top_folder": F.element_at(F.split(column, "/"), 1),
        "file_name": name,
        "file_date": F.element_at(F.split(F.replace(name, F.lit(".parquet"), F.lit("")), "_"), -1),
        "is_parquet": F.endswith(column, F.lit("parquet")),
    }
