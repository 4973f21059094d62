"""Projections, filters, joins, roll-ups and set operations."""

from pyspark.sql import functions as F

from checks.views import Tables, sql
from tillcast.functions import calendar, demand
from tillcast.operators import evaluate, facts, fill, lookups, prep
from tillcast.plans.daily import daily_store_sales
from tillcast.session import materialize


def proj_rename(t: Tables):
    return t.sales.withColumnRenamed("revenue", "sales").select(
        "date", "store_id", "product_id", "sales"
    )


def proj_exclude(t: Tables):
    columns = prep.feature_columns(t.store_day, "sales", ["date", "profit"])
    return t.store_day.select(*columns)


def filter_date_range(t: Tables):
    low, high = F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date")
    return t.sales.filter(F.col("date").between(low, high)).select(
        "date", "store_id", "product_id", "quantity_sold"
    )


def weather(t: Tables):
    ratio = F.col("customer_traffic") / F.lit(4.0)
    return t.customer_traffic.select("date", "store_id", ratio.alias("weather_impact"))


def clamp(t: Tables):
    return weather(t).withColumn("weather_impact", demand.clamp("weather_impact"))


def product_day(t: Tables):
    """The roll-up; its plain means are compared to 9 digits."""
    return facts.product_day(t.sales).withColumns(
        {c: F.round(c, 9) for c in ("discount_percent", "unit_price")}
    )


def product_day_fine(t: Tables):
    """The roll-up of amounts and discounts with more than 4 decimals."""
    fine = t.sales.withColumns({
        "discount_percent": F.col("discount_percent") / F.lit(7.0),
        "revenue": F.round(F.col("revenue") / F.lit(3.0), 7),
    })
    return facts.product_day(fine).select(
        "date", "store_id", "product_id", "category", F.round("sales", 7).alias("sales"),
        F.round("discount_percent", 9).alias("discount_percent"),
    )


def join_promotions(t: Tables):
    return facts.join_promotions(product_day(t), t.promotions)


def join_traffic(t: Tables):
    return facts.join_traffic(product_day(t), t.customer_traffic)


def join_actual_pred(t: Tables):
    return evaluate.join_actual(t.predictions.drop("actual"), t.daily)


def lookup_store_event(t: Tables):
    return lookups.lookup_store_event(t.daily.select("date", "store_id"), t.store_events)


def product_keys(t: Tables):
    return t.sales.select("date", "store_id", "product_id", "category").distinct()


def lookup_promo_price(t: Tables):
    return lookups.lookup_promo_price(product_keys(t), t.promotions)


def lookup_dims(t: Tables):
    return lookups.lookup_dims(
        product_keys(t), t.stores.drop("location"), t.products
    )


def spine_cross(t: Tables):
    rolled = facts.product_day(t.sales).groupBy("date", "store_id", "category").agg(
        F.sum("quantity_sold").alias("quantity_sold")
    )
    return lookups.densify(
        materialize(rolled, "rolled"), ["store_id", "category"], ["quantity_sold"]
    )


def promo_ratio(t: Tables):
    return daily_store_sales(
        t.sales, t.promotions, t.customer_traffic, promo_ratio=True
    )


def union_daily(t: Tables):
    sold = t.sales.select("date", "store_id", "quantity_sold", F.lit("sales").alias("data_type"))
    seen = t.customer_traffic.select(
        "date", "store_id", F.col("customer_traffic").cast("double").alias("quantity_sold"),
        F.lit("customer_traffic").alias("data_type"),
    )
    return facts.union_facts(sold, seen)


def union_history_request(t: Tables):
    accepted, _ = calendar.split_requests(t.requests)
    points = accepted.select("store_id", F.col("request_date").alias("date"), F.lit(True).alias("is_request"))
    return facts.union_facts(t.daily.withColumn("is_request", F.lit(False)), points)


QUERIES = {
    "proj_rename": (proj_rename, sql(
        "select date, store_id, product_id, revenue as sales from {sales}")),
    "proj_drop_leakage": (lambda t: facts.drop_leakage(t.store_day), sql("select * from {daily}")),
    "proj_exclude": (proj_exclude, sql("""select store_id, quantity_sold, has_promotion,
        customer_traffic, is_holiday from {store_day}""")),
    "filter_store": (lambda t: t.daily.filter(F.col("store_id") == 7), sql(
        "select * from {daily} where store_id = 7")),
    "filter_positive_qty": (
        lambda t: t.sales.filter(F.col("quantity_sold") > 0).select(
            "date", "store_id", "product_id", "quantity_sold"),
        sql("select date, store_id, product_id, quantity_sold from {sales} where quantity_sold > 0")),
    "filter_weekly_snapshot": (
        lambda t: t.inventory_daily.filter(F.weekday("date") == 6),
        sql("select * from {inventory_daily} where isodow(date) = 7")),
    "filter_date_range": (filter_date_range, sql("""select date, store_id, product_id, quantity_sold
        from {sales} where date between date '1997-01-01' and date '1998-12-31'""")),
    "drop_null_target": (
        lambda t: fill.drop_null_target(t.store_day, "customer_traffic"),
        sql("select * from {store_day} where customer_traffic is not null")),
    "fill_flag": (lambda t: fill.fill_flag(t.daily), sql("""select date, store_id, sales,
        coalesce(cast(has_promotion as int), 0) as has_promotion, is_holiday from {daily}""")),
    "clamp": (clamp, sql("""select date, store_id, greatest(0.5::double,
        least(1.2::double, customer_traffic / 4.0::double)) as weather_impact
        from {customer_traffic}""")),
    "join_promotions": (join_promotions, sql("""select p.*, has_promotion from {product_day} p
        left join {promo_summary} using (date, product_id)""")),
    "join_traffic": (join_traffic, sql("""select p.*, customer_traffic, is_holiday
        from {product_day} p left join {traffic_day} using (date, store_id)""")),
    "join_actual_pred": (join_actual_pred, sql("""select date, store_id, model, prediction,
        sales as actual from {predictions} join {daily} using (date, store_id)""")),
    "lookup_store_event": (lookup_store_event, sql("""select d.date, d.store_id,
        coalesce(1.0::double + e.impact, 1.0::double) as event_impact from {daily} d left join
        (select *, row_number() over (partition by store_id, date order by event_type, impact) as rn
         from {store_events}) e on d.store_id = e.store_id and d.date = e.date and rn = 1""")),
    "lookup_promo_price": (lookup_promo_price, sql("""select k.*,
        coalesce(p.discount_percent, 0.0) as discount_percent,
        1.0::double + coalesce(p.discount_percent, 0.0) * 3.0::double as promotion_factor
        from (select distinct date, store_id, product_id, category from {sales}) k left join
        (select *, row_number() over (partition by date, product_id
           order by promotion_type, discount_percent) as rn from {promotions}) p
        on k.date = p.date and k.product_id = p.product_id and rn = 1""")),
    "lookup_holiday": (
        lambda t: lookups.lookup_holiday(t.daily.select("date", "store_id"), t.holidays),
        sql("""select date, store_id, date in (select date from {holidays}) as is_holiday
        from {daily}""")),
    "lookup_dims": (lookup_dims, sql("""select k.*, size, base_traffic, seasonality, price, margin
        from (select distinct date, store_id, product_id, category from {sales}) k
        left join {stores} using (store_id) left join {products} using (product_id)""")),
    "spine_cross": (spine_cross, sql("""select store_id, category, cast(d as date) as date,
        coalesce(q, 0.0) as quantity_sold
        from (select distinct store_id, category from {product_day}) k,
        (select unnest(generate_series(min(date), max(date), interval 1 day)) as d from {product_day})
        left join (select date, store_id as s, category as c, sum(quantity_sold) as q
                   from {product_day} group by all) f
        on f.date = cast(d as date) and f.s = k.store_id and f.c = k.category""")),
    "agg_product_day": (product_day, sql("select * from {product_day}")),
    "agg_product_day_fine": (product_day_fine, sql("""select date, store_id, product_id, category,
        round(sum(round(revenue / 3.0::double, 7)), 7) as sales,
        round(avg(discount_percent / 7.0::double), 9) as discount_percent
        from {sales} group by all""")),
    "agg_promo_summary": (
        lambda t: facts.promotion_summary(t.promotions), sql("select * from {promo_summary}")),
    "agg_traffic_day": (
        lambda t: facts.traffic_day(t.customer_traffic), sql("select * from {traffic_day}")),
    "agg_store_day": (lambda t: t.store_day, sql("select * from {store_day}")),
    "daily_store_sales": (lambda t: t.daily, sql("select * from {daily}")),
    "daily_promo_ratio": (promo_ratio, sql("""select d.*, promo_ratio from {daily} d left join
        (select date, store_id, count(has_promotion) / count(*)::double as promo_ratio
         from {product_day} left join {promo_summary} using (date, product_id)
         group by date, store_id) using (date, store_id)""")),
    "union_daily": (union_daily, sql("""select date, store_id, quantity_sold, 'sales' as data_type
        from {sales} union all select date, store_id, customer_traffic::double,
        'customer_traffic' from {customer_traffic}""")),
    "union_history_request": (union_history_request, sql("""select *, false as is_request
        from {daily} union all by name select store_id, try_cast(date as date) as date,
        true as is_request from {requests}
        where regexp_matches(date, '^[0-9]+-[0-9]+-[0-9]+$')""")),
}
