"""Lag, rolling and latest-row operators.

A frame counts rows, not days. On the store-day table a group holds at most one row per
calendar day, so one store is never more than a few thousand rows and a plain window is safe.
For groups without such a bound, or none at all, pass ``block_rows``: the ordered table is cut
into blocks with an overlap as deep as the longest frame, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast import config
from tillcast.operators import ordering


FRAME_FUNCTIONS = ("mean", "std")
SORTED_FUNCTIONS = ("min", "max", "median")


def _with_statistics(
    df: DataFrame,
    target: str,
    lags: list[int],
    windows: list[int],
    functions: list[str],
    window,
    prefix: str,
) -> DataFrame:
    """Add all columns over one window specification.

    A sliding median needs the frame's values in order. Each frame is therefore gathered and
    sorted once, at most as many values as the frame has rows, and its median, minimum and
    maximum are read from that array.
    """
    unknown = set(functions) - {*FRAME_FUNCTIONS, *SORTED_FUNCTIONS}
    if unknown:
        raise ValueError(f"unknown rolling functions {sorted(unknown)}")
    from_array = "median" in functions
    framed = {f"{prefix}_lag_{k}": F.lag(target, k).over(window) for k in lags}
    names, read = list(framed), {}
    for w in windows:
        frame = window.rowsBetween(-w, -1)
        gathered = f"__values_{w}"
        if from_array:
            framed[gathered] = F.sort_array(F.collect_list(target).over(frame))
        for f in functions:
            name = f"{prefix}_rolling_{w}_{f}"
            names.append(name)
            if f == "mean":
                # sum / count keeps a decimal target exact
                framed[name] = F.try_divide(
                    F.sum(target).over(frame).cast("double"), F.count(target).over(frame)
                )
            elif f == "std":
                framed[name] = F.stddev_samp(target).over(frame)
            elif from_array:
                read[name] = _from_sorted(gathered, f)
            else:
                framed[name] = (F.min if f == "min" else F.max)(target).over(frame)
    made = df.withColumns(framed)
    if read:
        made = made.withColumns(read)
    return made.select(*[c for c in df.columns if c not in names], *names)


def _from_sorted(values: str, name: str) -> Column:
    last = F.size(values) - 1
    if name == "min":
        return F.get(values, F.lit(0))
    if name == "max":
        return F.get(values, last)
    low = F.get(values, F.floor(last / 2).cast("int")).cast("double")
    high = F.get(values, F.ceil(last / 2).cast("int")).cast("double")
    return F.when(last >= 0, (low + high) * F.lit(0.5))


def sequence_features(
    df: DataFrame,
    target: str = "sales",
    order_cols: list[str] | None = None,
    group_cols: list[str] | None = None,
    lags: list[int] | None = None,
    windows: list[int] | None = None,
    functions: list[str] | None = None,
    block_rows: int | None = None,
    prefix: str = "sales",
) -> DataFrame:
    """Add lag and rolling columns of ``target``; all share one shuffle and one sort."""
    order_cols = order_cols or ["date"]
    group_cols = group_cols or []
    lags = config.LAGS if lags is None else lags
    windows = config.ROLLING_WINDOWS if windows is None else windows
    functions = functions or config.ROLLING_FUNCTIONS
    if group_cols and block_rows is None:
        window = W.partitionBy(*group_cols).orderBy(*order_cols)
        return _with_statistics(df, target, lags, windows, functions, window, prefix)
    sequence = [*group_cols, *[c for c in order_cols if c not in group_cols]]
    depth = max([*lags, *windows], default=0)
    blocks = ordering.with_blocks(df, sequence, depth, block_rows or ordering.BLOCK_ROWS)
    window = W.partitionBy("__block", *group_cols).orderBy("__position")
    return ordering.drop_halo(
        _with_statistics(blocks, target, lags, windows, functions, window, prefix)
    )


def lag_features(df: DataFrame, target: str = "sales", **options) -> DataFrame:
    return sequence_features(df, target, windows=[], **options)


def rolling_features(df: DataFrame, target: str = "sales", **options) -> DataFrame:
    """Statistics of the rows before the current one. ``windows=[3]`` gives the short set."""
    return sequence_features(df, target, lags=[], **options)


def seasonal_lag(
    df: DataFrame, target: str = "sales", keys: tuple[str, ...] = ("store_id",), months: int = 12
) -> DataFrame:
    """Add the target of the same date one year earlier. Keys and date are unique."""
    past = df.select(
        *keys, F.col("date").alias("__past"), F.col(target).alias(f"{target}_last_year")
    )
    return (
        df.withColumn("__past", F.add_months("date", -months))
        .join(past, [*keys, "__past"], "left")
        .drop("__past")
    )


def latest_per_group(
    df: DataFrame, n: int, group_cols: list[str], order_col: str = "date",
    before: Column | None = None,
) -> DataFrame:
    """The newest ``n`` rows of each group, optionally only those before a date.

    Spark cuts each group to ``n`` rows before the shuffle, so a large group costs n rows per
    map task.
    """
    rows = df if before is None else df.filter(F.col(order_col) < before)
    newest = W.partitionBy(*group_cols).orderBy(F.col(order_col).desc())
    return rows.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= n).drop("__rn")


def top_k(
    df: DataFrame, k: int, group_cols: list[str], value: str, tie: str, largest: bool = True,
    rank_name: str = "rank",
) -> DataFrame:
    """The k rows with the largest (or smallest) value per group, ranked."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    window = W.partitionBy(*group_cols).orderBy(order, F.col(tie))
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= k)
