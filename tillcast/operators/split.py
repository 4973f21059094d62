"""Chronological split by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillcast import config
from tillcast.operators import ordering


def split_chrono(
    df: DataFrame,
    date_col: str = "date",
    tie_cols: tuple[str, ...] = ("store_id",),
    train_size: float = config.TRAIN_SIZE,
    val_size: float = config.VAL_SIZE,
    name: str = "split",
) -> DataFrame:
    """Label the oldest rows train, the next val and the rest test.

    Only two keys matter: the first of val and the first of test. They are found from row
    counts per day and the keys of the day that holds the cut, and every row is then labelled
    by comparison with them, without moving it. The keys are read a few times: pass a stored
    table. ``date_col`` and ``tie_cols`` together are unique and not null.
    """
    columns = [date_col, *tie_cols]
    n_train = (F.col("total") * F.lit(float(train_size))).cast("bigint")
    n_val = (F.col("total") * F.lit(float(val_size))).cast("bigint")
    cuts = ordering.keys_at(
        df.select(*columns), {"val": n_train, "test": n_train + n_val}, date_col, list(tie_cols)
    )
    label = F.lit("test")
    if "test" in cuts:
        label = F.when(ordering.before(cuts["test"], columns), "val").otherwise(label)
    else:
        label = F.lit("val")
    if "val" in cuts:
        label = F.when(ordering.before(cuts["val"], columns), "train").otherwise(label)
    else:
        label = F.lit("train")
    return df.withColumn(name, label)
