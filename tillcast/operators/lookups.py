"""Dimension lookups, calendars and the dense date spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast import config


#: Days of a block of the interval join.
BUCKET_DAYS = 32


def lookup_holiday(df: DataFrame, holidays: DataFrame, date_col: str = "date") -> DataFrame:
    """Add ``is_holiday``: whether the date is in the calendar.

    A calendar holds each date once, some 3,650 rows of 4 bytes per decade, so broadcasting
    its distinct dates is safe at any size of ``df``.
    """
    calendar = holidays.select(F.col("date").alias("__holiday")).distinct()
    return (
        df.drop("is_holiday")
        .join(F.broadcast(calendar), F.col(date_col) == F.col("__holiday"), "left")
        .withColumn("is_holiday", F.col("__holiday").isNotNull())
        .drop("__holiday")
    )


def lookup_store_event(
    df: DataFrame, events: DataFrame, default: float = 1.0, base: float = 1.0
) -> DataFrame:
    """Add ``event_impact``: ``base`` plus the impact of the first event of the store and date.

    First means lowest by type and impact; it is reduced before the shuffle, so many events of
    one day cost no more than one.
    """
    first = (
        events.groupBy("store_id", "date")
        .agg(F.min(F.struct("event_type", "impact")).alias("__event"))
    )
    return (
        df.join(first, ["store_id", "date"], "left")
        .withColumn("event_impact", F.coalesce(F.lit(base) + F.col("__event.impact"), F.lit(default)))
        .drop("__event")
    )


def interval_join(
    df: DataFrame, intervals: DataFrame, keys: list[str], at: str = "date", start: str = "start",
    end: str = "end", bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Rows of ``df`` with every interval of their keys that holds their date, both ends included.

    An interval stays one row for each block of ``bucket_days`` days it touches; a date lies in one
    block, so key and block make a plain hash join, whose hot groups AQE splits, and the ends are
    compared inside it. An interval without an end runs to the last date of ``df``, which is read
    for its span: pass a stored table. A null date, key or start meets nothing.
    """
    block = lambda c: F.floor(F.unix_date(c) / F.lit(bucket_days)).cast("int")
    span = df.agg(F.struct(F.min(at).alias("lo"), F.max(at).alias("hi")).alias("span")).scalar()
    spans = intervals.withColumn("__span", span)
    first = F.greatest(F.col(start), F.col("__span.lo"))
    last = F.least(F.coalesce(F.col(end), F.col("__span.hi")), F.col("__span.hi"))
    spans = spans.filter(F.col(start).isNotNull() & (first <= last))
    spans = spans.withColumn("__block", F.explode(F.sequence(block(first), block(last)))).drop("__span")
    joined = df.withColumn("__block", block(F.col(at))).join(spans, [*keys, "__block"])
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.coalesce(F.col(end), F.col(at)))
    return joined.filter(inside).drop("__block")


def lookup_store_interval(
    df: DataFrame, events: DataFrame, default: float = 1.0, base: float = 1.0,
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Add ``event_impact`` from events that last: (store_id, start, end, event_type, impact).

    Of several events of a store and date the one that started last counts, then the first by
    type and impact; an open-ended event lasts. Only the keys of ``df`` meet the events, once
    each, and one event per key comes back, so rows are neither multiplied nor lost.
    """
    keys = df.select("store_id", "date").distinct()
    rank = F.struct((-F.unix_date("start")).alias("age"), "event_type", "impact")
    first = (
        interval_join(keys, events.select("store_id", "start", "end", "event_type", "impact"), ["store_id"], bucket_days=bucket_days)
        .groupBy("store_id", "date").agg(F.min(rank).alias("__event"))
    )
    return (
        df.join(first, ["store_id", "date"], "left")
        .withColumn("event_impact", F.coalesce(F.lit(base) + F.col("__event.impact"), F.lit(default)))
        .drop("__event")
    )


def lookup_promo_price(
    df: DataFrame,
    promotions: DataFrame,
    multiplier: float = config.PROMOTION_MULTIPLIER,
    priority: list[str] | None = None,
) -> DataFrame:
    """Add the discount of the first promotion of the date and product, and its demand factor.

    First means earliest in ``priority``, by default the yearly events in their order; types
    outside it follow by name and discount.
    """
    priority = priority or [name for name, *_ in config.PROMOTION_EVENTS]
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("promotion_type"))
    first = (
        promotions.groupBy("date", "product_id")
        .agg(
            F.min(
                F.struct(
                    F.when(place == 0, len(priority) + 1).otherwise(place).alias("place"),
                    "promotion_type",
                    "discount_percent",
                )
            ).alias("__promo")
        )
    )
    discount = F.coalesce(F.col("__promo.discount_percent"), F.lit(0.0))
    return (
        df.drop("discount_percent")
        .join(first, ["date", "product_id"], "left")
        .withColumn("discount_percent", discount)
        .withColumn("promotion_factor", F.lit(1.0) + F.col("discount_percent") * F.lit(multiplier))
        .drop("__promo")
    )


def lookup_dims(df: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Attach store and product attributes; the planner broadcasts a dimension that is small."""
    return df.join(stores, "store_id", "left").join(products, "product_id", "left")


def spine(
    facts: DataFrame, key_cols: list[str], start: str | None = None, end: str | None = None
) -> DataFrame:
    """Every date of the span for every key combination that occurs in ``facts``.

    Each key carries its own date sequence, so the spine is generated by the tasks that hold
    the keys and needs no cross join. The span defaults to that of the facts. Span and keys are
    separate passes: pass a stored table.
    """
    span = facts.agg(
        F.struct(F.min("date").alias("lo"), F.max("date").alias("hi")).alias("span")
    ).scalar()
    keys = facts.select(*key_cols).distinct().withColumn("__span", span)
    lo = F.lit(start).cast("date") if start else F.col("__span.lo")
    hi = F.lit(end).cast("date") if end else F.col("__span.hi")
    return keys.select(*key_cols, F.explode(F.sequence(lo, hi)).alias("date"))


def densify(facts: DataFrame, key_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Facts on the full spine, with 0 where a key has no row. Facts are unique per key and date."""
    full = spine(facts, key_cols).join(
        facts.select(*key_cols, "date", *value_cols), [*key_cols, "date"], "left"
    )
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in value_cols})


def except_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``expected`` that ``found`` lacks."""
    return expected.select(*keys).join(found.select(*keys), keys, "left_anti")


def missing_dates(
    found: DataFrame, keys: list[str], start: str | None = None, end: str | None = None
) -> DataFrame:
    """(keys, date) of every date of the span that a key lacks, made from its gaps alone.

    Each present row looks at the key's next one and unfolds the dates between; the first row also
    those before it. What is made are the missing keys and no others: no spine, no anti-join.
    The span defaults to that of ``found``; rows outside a given span are left aside, and a key with
    none inside lacks all of it. Repeated rows count once. A key has one row per day, so its window
    is bounded by the calendar. Pass a stored table: span and gaps are separate passes.
    """
    span = found.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi")).alias("span")).scalar()
    lo = F.lit(start).cast("date") if start else F.col("__span.lo")
    hi = F.lit(end).cast("date") if end else F.col("__span.hi")
    present = found.select(*keys, "date").distinct().withColumn("__span", span)
    inside = F.when(F.col("date").between(lo, hi), F.col("date"))
    # a key without a date inside keeps one row, so that its whole span is a gap
    rows = present.select(*keys, inside.alias("date"), lo.alias("__lo"), hi.alias("__hi")).distinct()
    order = W.partitionBy(*keys).orderBy(F.col("date").asc_nulls_first())
    following = F.lead("date").over(order)
    after = F.when(F.col("date").isNull(), F.col("__lo")).otherwise(F.date_add("date", 1))
    before = F.date_sub(F.coalesce(following, F.date_add("__hi", 1)), 1)
    leading = F.when((F.row_number().over(order) == 1) & F.col("date").isNotNull(), F.date_sub("date", 1))
    gaps = rows.select(
        *keys, "__lo", after.alias("__a"), before.alias("__b"), leading.alias("__c")
    )
    dates = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<date>)"))
    return gaps.select(
        *keys,
        F.explode(F.concat(dates(F.col("__lo"), F.coalesce("__c", F.date_sub("__lo", 1))), dates(F.col("__a"), F.col("__b")))).alias("date"),
    )
