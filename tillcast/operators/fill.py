"""Null handling of features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.operators import ordering


def sequence_columns(df: DataFrame) -> list[str]:
    """Columns named like the lag and rolling features, with their number."""
    return [c for c in df.columns if re.search(r"_lag_\d+$|_rolling_\d+_", c)]


def fill_sequences(
    df: DataFrame,
    columns: list[str] | None = None,
    group_cols: tuple[str, ...] = ("store_id",),
    order_col: str = "date",
    scope: str = "group",
) -> DataFrame:
    """Fill nulls of lag and rolling columns forward, then backward.

    ``scope="group"`` stays inside a group and shares the window of the features.
    ``scope="global"`` runs through the whole table in (group, date) order.
    """
    columns = sequence_columns(df) if columns is None else columns
    if not columns:
        return df
    if scope == "global":
        return ordering.carry_fill(df, [*group_cols, order_col], columns)
    if scope != "group":
        raise ValueError(f"unknown scope {scope}")
    window = W.partitionBy(*group_cols).orderBy(order_col)
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    # After the forward fill only the head of a group is null, so its backward fill is the
    # first value of the group: one value per group instead of a shrinking frame per row.
    whole = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, True).over(upto), F.first(c, True).over(whole)) for c in columns}
    )


def fill_flag(df: DataFrame, column: str = "has_promotion") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("int"), F.lit(0)))


def drop_null_target(df: DataFrame, target: str = "sales") -> DataFrame:
    return df.dropna(subset=[target])
