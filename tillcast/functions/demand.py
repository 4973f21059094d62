"""The deterministic demand model: seasonal, weekday, price and promotion factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillcast import config


def _wave(date_col: str, base: float, height: float, shift: int, period: int) -> Column:
    turn = F.lit(2.0) * F.pi() * (F.dayofyear(date_col) - F.lit(shift)) / F.lit(float(period))
    return F.lit(base) + F.lit(height) * F.sin(turn)


def seasonality_factor(date_col: str, season: str, holiday: str = "is_holiday") -> Column:
    """Demand factor of a product's season type on a date."""
    month = F.month(date_col)
    kind = F.col(season)
    return (
        F.when(
            kind == "holiday",
            F.when(month.isin(11, 12), _wave(date_col, 1.5, 0.3, 300, 60))
            .when(F.col(holiday), 1.3)
            .otherwise(1.0),
        )
        .when(kind == "summer", _wave(date_col, 1.0, 0.4, 80, 365))
        .when(kind == "winter", _wave(date_col, 1.0, 0.3, -90, 365))
        .when(kind == "spring", _wave(date_col, 1.0, 0.3, 20, 365))
        .when(kind == "back_to_school", F.when(month.isin(8, 9), 1.4).otherwise(0.9))
        .when(
            kind == "fitness",
            F.when(month == 1, 1.5).when(month.isin(5, 6), 1.3).otherwise(1.0),
        )
        .otherwise(1.0)
    )


def weekday_factor(date_col: str) -> Column:
    factors = F.array(*[F.lit(float(f)) for f in config.WEEKDAY_FACTORS])
    return F.element_at(factors, F.weekday(date_col) + 1)


def size_factor(size: str) -> Column:
    pairs = [F.lit(x) for pair in config.SIZE_FACTORS.items() for x in pair]
    return F.create_map(*pairs)[F.col(size)]


def price_factor(price: str) -> Column:
    return F.lit(0.5) + F.lit(0.5) * F.exp(-F.col(price) / F.lit(500.0))


def clamp(column: str, bounds: tuple[float, float] = config.WEATHER_BOUNDS) -> Column:
    low, high = bounds
    return F.when(
        F.col(column).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))
    )


def truncated(value: Column) -> Column:
    """Whole part, cut towards zero."""
    return value.cast("bigint")


def expected_traffic(df: DataFrame) -> DataFrame:
    """Add ``expected_traffic`` from base_traffic, date, is_holiday and event_impact."""
    holiday = F.when(F.col("is_holiday"), config.HOLIDAY_TRAFFIC_FACTOR).otherwise(1.0)
    raw = F.col("base_traffic") * weekday_factor("date") * holiday * F.col("event_impact")
    return df.withColumn("expected_traffic", truncated(raw))


def expected_quantity(df: DataFrame) -> DataFrame:
    """Add ``expected_quantity`` from traffic, size, price, seasonality and promotion_factor."""
    raw = (
        F.col("expected_traffic")
        * F.lit(config.CONVERSION_RATE)
        * size_factor("size")
        * price_factor("price")
        * seasonality_factor("date", "seasonality")
        * F.col("promotion_factor")
    )
    return df.withColumn("expected_quantity", truncated(raw))


def price_pnl(df: DataFrame, quantity: str, price: str, discount: str, margin: str) -> DataFrame:
    """Add actual_price, revenue, cost and profit."""
    actual = F.col(price) * (F.lit(1.0) - F.col(discount))
    revenue = F.col(quantity) * actual
    cost = F.col(quantity) * F.col(price) * (F.lit(1.0) - F.col(margin))
    return df.withColumns(
        {"actual_price": actual, "revenue": revenue, "cost": cost, "profit": revenue - cost}
    )


def days_of_supply(df: DataFrame) -> DataFrame:
    """Add days_of_supply and whether the stock is at or below the reorder point."""
    return df.withColumns(
        {
            "days_of_supply": F.col("inventory_level")
            / F.greatest(F.lit(1), F.col("quantity_sold")).cast("double"),
            "needs_reorder": F.col("inventory_level") <= F.col("reorder_point"),
        }
    )
