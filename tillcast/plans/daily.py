"""Daily facts to the store-day table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillcast import config
from tillcast.operators import facts
from tillcast.operators.quality import require_columns


def daily_store_sales(
    sales: DataFrame,
    promotions: DataFrame | None = None,
    traffic: DataFrame | None = None,
    keep_all: bool = False,
    promo_ratio: bool = False,
    scale: int = facts.MONEY_SCALE,
) -> DataFrame:
    """Sales, promotion flag and holiday flag per date and store.

    Traffic joins after the roll-up: it is keyed by date and store, so the result is the same
    and the join reuses the partitioning of the aggregate on far fewer rows. Without promotions
    or traffic their columns are null. ``keep_all`` keeps the columns that leak the target;
    ``scale`` is the number of decimals that sums keep.
    """
    require_columns(sales, config.REQUIRED_COLUMNS)
    daily = facts.store_day(sales, promotions, promo_ratio, scale)
    if traffic is not None:
        daily = facts.join_traffic(daily, traffic)
    else:
        daily = daily.withColumns(
            {
                "customer_traffic": F.lit(None).cast("bigint"),
                "is_holiday": F.lit(None).cast("boolean"),
            }
        )
    return daily if keep_all else facts.drop_leakage(daily)
