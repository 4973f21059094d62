"""Calendar columns, date parsing and date expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillcast import config


def date_parts(date_col: str = "date", wanted: list[str] | None = None) -> dict[str, Column]:
    """Date features by name; weekdays count from Monday = 0 and weeks are ISO weeks."""
    day = F.col(date_col)
    parts = {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.day(day),
        "dayofweek": F.weekday(day),
        "quarter": F.quarter(day),
        "weekofyear": F.weekofyear(day),
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }
    wanted = config.DATE_FEATURES if wanted is None else wanted
    return {name: parts[name] for name in wanted if name in parts}


def cyclical(date_col: str = "date") -> dict[str, Column]:
    """Sine and cosine of each calendar cycle."""
    parts = date_parts(date_col, list(config.CYCLES))
    out = {}
    for name, period in config.CYCLES.items():
        angle = F.lit(2.0) * F.pi() * parts[name] / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def interactions(columns: list[str]) -> dict[str, Column]:
    """Joined text of every pair of columns; null when either side is."""
    return {
        f"{a}_{b}_interaction": F.concat(
            F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string")
        )
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    }


def parse_request_date(text: str) -> Column:
    """Date of a strict YYYY-MM-DD text, else null."""
    shaped = F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(shaped, F.try_to_date(F.col(text), "yyyy-MM-dd"))


def split_requests(requests: DataFrame, text: str = "date") -> tuple[DataFrame, DataFrame]:
    """Accepted requests with a real date, and the rejected ones."""
    parsed = requests.withColumn("request_date", parse_request_date(text))
    accepted = parsed.filter(F.col("request_date").isNotNull())
    rejected = parsed.filter(F.col("request_date").isNull()).drop("request_date")
    return accepted, rejected


def expand_days(df: DataFrame, start: str, days: str | int, name: str = "date") -> DataFrame:
    """One row per day of an interval of ``days`` days from ``start``."""
    length = F.lit(days) if isinstance(days, int) else F.col(days)
    last = F.date_add(F.col(start), (length - 1).cast("int"))
    return df.filter(length > 0).withColumn(name, F.explode(F.sequence(F.col(start), last)))


def forecast_dates(df: DataFrame, start: str, days: int, name: str = "date") -> DataFrame:
    """The ``days`` dates from ``start`` on, as YYYY-MM-DD text."""
    return expand_days(df, start, days, "__day").withColumn(
        name, F.date_format("__day", "yyyy-MM-dd")
    ).drop("__day")


def event_calendar(
    span: DataFrame, events: list[tuple] | None = None
) -> DataFrame:
    """Event days of every year of a span, as (date, promotion_type, discount_percent).

    ``span`` is one row with dates ``lo`` and ``hi``. An event counts when its first day lies in
    the span and is clipped at the end of it. A day of None means the Friday after the fourth
    Thursday. The result is bounded by the calendar.
    """
    events = events or config.PROMOTION_EVENTS
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("promotion_type"),
                F.lit(month).alias("month"),
                F.lit(day).cast("int").alias("day"),
                F.lit(days).alias("days"),
                F.lit(float(discount)).alias("discount_percent"),
            )
            for name, month, day, days, discount in events
        ]
    )
    years = span.select(
        "lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("year")
    ).select("lo", "hi", "year", F.inline(rows))
    first_of_month = F.make_date("year", "month", F.lit(1))
    # next_day looks strictly after its argument, so start from the last day of the month before
    fourth_thursday = F.date_add(F.next_day(F.date_sub(first_of_month, 1), "THU"), 21)
    start = F.coalesce(F.make_date("year", "month", "day"), F.date_add(fourth_thursday, 1))
    dated = years.withColumn("start", start).filter(F.col("start").between(F.col("lo"), F.col("hi")))
    return expand_days(dated, "start", "days").filter(F.col("date") <= F.col("hi")).select(
        "date", "promotion_type", "discount_percent"
    )
