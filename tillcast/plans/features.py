"""Store-day table to model features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillcast import config
from tillcast.functions import calendar
from tillcast.operators import fill, lookups, windows
from tillcast.session import materialize


def all_features(
    daily: DataFrame,
    holidays: DataFrame,
    target: str = config.TARGET,
    date_col: str = config.DATE,
    group_cols: tuple[str, ...] = ("store_id",),
    categorical_cols: list[str] | None = None,
    lags: list[int] | None = None,
    windows_: list[int] | None = None,
    functions: list[str] | None = None,
    fill_scope: str = "group",
) -> DataFrame:
    """Date, lag, rolling, cyclical and interaction features, filled, without null targets.

    Lags, rolling statistics and the per-group fill share one shuffle and one sort by group and
    date. Everything that depends on a single row is added after it, so the shuffle carries the
    daily columns only.
    """
    sequenced = windows.sequence_features(
        daily, target, [date_col], list(group_cols), lags, windows_, functions
    )
    columns = [c for c in sequenced.columns if c not in daily.columns]
    if fill_scope == "global":  # reads its input several times
        sequenced = materialize(sequenced, "sequences")
    made = fill.fill_sequences(sequenced, columns, group_cols, date_col, fill_scope)
    parts, waves = calendar.date_parts(date_col), calendar.cyclical(date_col)
    made = made.withColumns({**parts, **waves})
    if "is_holiday" in config.DATE_FEATURES:
        made = lookups.lookup_holiday(made, holidays, date_col)
    pairs = calendar.interactions(categorical_cols or [])
    made = made.withColumns(pairs) if pairs else made
    if "has_promotion" in made.columns:
        made = fill.fill_flag(made)
    kept = [c for c in daily.columns if c != "is_holiday"]
    ordered = [*kept, *parts, "is_holiday", *columns, *waves, *pairs]
    made = made.select(*[c for c in ordered if c in made.columns])
    return fill.drop_null_target(made, target)
