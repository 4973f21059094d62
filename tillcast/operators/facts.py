"""Roll-ups of daily facts and the joins between them.

A group key that is null drops the row. Money is summed in whole numbers, the whole parts and
the fractions to ``MONEY_SCALE`` decimals apart, so that a sum does not depend on task order; means
are plain means of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(18,4)"
#: Decimals that a sum keeps of every amount.
MONEY_SCALE = 8


def _known(column: str) -> Column:
    """The number as a double; NaN is missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def limbs(column: str, scale: int = MONEY_SCALE) -> tuple[Column, Column]:
    """An amount as whole part and units of ``scale`` decimals, both whole numbers."""
    amount = _known(column)
    whole = F.floor(amount)
    return whole.cast("bigint"), F.rint((amount - whole) * F.lit(10.0**scale)).cast("bigint")


def joined(whole: Column, units: Column, scale: int = MONEY_SCALE) -> Column:
    """The amount of two added-up limbs; 0 where nothing was added."""
    unit = 10**scale
    whole, units = F.coalesce(whole, F.lit(0)), F.coalesce(units, F.lit(0))
    carry = F.floor(units / F.lit(unit)).cast("bigint")
    return (whole + carry).cast("double") + (units - carry * F.lit(unit)) / F.lit(float(unit))


def exact_sum(column: str, scale: int = MONEY_SCALE) -> Column:
    """Sum to ``scale`` decimals, the same in any order; a sum of nothing is 0.

    Whole parts and fractions are added up apart, so a group's sum may reach 9.2e18, whatever the
    scale; beyond that it is an ANSI error.
    """
    whole, units = limbs(column, scale)
    return joined(F.sum(whole), F.sum(units), scale).alias(column)


def mean(column: str) -> Column:
    return F.avg(_known(column)).alias(column)


def has_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def product_day(sales: DataFrame, scale: int = MONEY_SCALE) -> DataFrame:
    """Sales per date, store, product and category, amounts to ``scale`` decimals."""
    keys = ["date", "store_id", "product_id", "category"]
    return (
        has_keys(sales, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("quantity_sold"), F.lit(0)).alias("quantity_sold"),
            exact_sum("revenue", scale),
            exact_sum("cost", scale),
            exact_sum("profit", scale),
            mean("discount_percent"),
            mean("unit_price"),
        )
        .withColumnRenamed("revenue", "sales")
    )


def promotion_summary(promotions: DataFrame) -> DataFrame:
    """Largest discount per date and product, flagged as a promotion."""
    keys = ["date", "product_id"]
    return (
        has_keys(promotions, keys)
        .groupBy(*keys)
        .agg(F.max("discount_percent").alias("max_discount"))
        .withColumn("has_promotion", F.lit(1))
    )


def traffic_day(traffic: DataFrame) -> DataFrame:
    """Traffic per date and store."""
    keys = ["date", "store_id"]
    return (
        has_keys(traffic, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("customer_traffic"), F.lit(0)).alias("customer_traffic"),
            F.max("is_holiday").alias("is_holiday"),
        )
    )


def join_promotions(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Flag sales of products on promotion that day. The summary is unique per key: no fan-out.

    No broadcast is forced: promotions grow with the data, so the planner decides by size, and
    AQE splits a day and product that holds too many rows.
    """
    flags = promotion_summary(promotions).select("date", "product_id", "has_promotion")
    return sales.join(flags, ["date", "product_id"], "left")


def join_traffic(daily: DataFrame, traffic: DataFrame) -> DataFrame:
    """Attach the day's traffic and holiday flag of the store."""
    return daily.join(traffic_day(traffic), ["date", "store_id"], "left")


def store_day(
    sales: DataFrame, promotions: DataFrame | None = None, promo_ratio: bool = False,
    scale: int = MONEY_SCALE,
) -> DataFrame:
    """Sales per date and store, in two branches.

    The measures need no promotion: raw rows are combined before their one shuffle. The flag needs
    keys only: sold products that were promoted that day, one row per date and store, so no
    measure travels to the promotions' keys. ``has_promotion`` is 1 when any product was on
    promotion and null otherwise. ``promo_ratio`` adds the share of the day's products, by
    category, on promotion.
    """
    keys = ["date", "store_id"]
    rows = has_keys(sales, [*keys, "product_id", "category"])
    daily = rows.groupBy(*keys).agg(
        F.coalesce(F.sum("quantity_sold"), F.lit(0)).alias("quantity_sold"),
        exact_sum("revenue", scale),
        exact_sum("profit", scale),
    ).withColumnRenamed("revenue", "sales")
    if promotions is None:
        daily = daily.withColumn("has_promotion", F.lit(None).cast("double"))
        return daily.withColumn("promo_ratio", F.lit(0.0)) if promo_ratio else daily
    product = ["date", "product_id"]
    promoted = has_keys(promotions, product).select(*product).distinct()
    if promo_ratio:
        sold = rows.select(*keys, "product_id", "category").distinct()
        flagged = sold.join(promoted.withColumn("__flag", F.lit(1.0)), product, "left")
        flags = flagged.groupBy(*keys).agg(
            F.max("__flag").alias("has_promotion"),
            (F.count("__flag") / F.count(F.lit(1))).alias("promo_ratio"),
        )
    else:
        sold = rows.select(*keys, "product_id").join(promoted, product, "left_semi")
        flags = sold.select(*keys).distinct().withColumn("has_promotion", F.lit(1.0))
    return daily.join(flags, keys, "left")


def drop_leakage(daily: DataFrame) -> DataFrame:
    """Drop the columns known only after the day is over."""
    return daily.drop("profit", "quantity_sold", "customer_traffic")


def union_facts(*tables: DataFrame) -> DataFrame:
    """UNION ALL of tables by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
