"""Window, scalar, split and preprocessing operators."""

from pyspark.sql import functions as F

from checks.views import (
    CYCLICAL_SQL, DATE_PARTS_SQL, SEQUENCE_COLUMNS, Tables, band, sql,
)
from tillcast.functions import calendar, demand, intervals, keys
from tillcast.operators import facts, fill, lookups, prep, split, windows
from tillcast.session import materialize

LAG_COLUMNS = [c for c in SEQUENCE_COLUMNS if "lag" in c]
ROLLING_COLUMNS = [c for c in SEQUENCE_COLUMNS if "rolling" in c]


def _rounded(columns):
    """Deviations and waves to digits both engines agree on; exact columns stay as they are."""
    def spark_cols(df):
        return df.withColumns({
            c: F.round(c, 2 if c.endswith("_std") else 9) for c in df.columns
            if c.endswith(("_std", "_sin", "_cos"))
        })
    text = ", ".join(
        f"round({c}, {2 if c.endswith('_std') else 9}) as {c}"
        for c in columns if c.endswith(("_std", "_sin", "_cos"))
    )
    return spark_cols, text


CYCLES = [f"{n}_{f}" for n in ["day", "month", "dayofweek"] for f in ["sin", "cos"]]
round_features, _ROUNDED = _rounded(SEQUENCE_COLUMNS + CYCLES)
_ROUNDED_STD = _rounded(SEQUENCE_COLUMNS)[1]
FEATURES_SQL = f"select * replace ({_ROUNDED}) from {{features}}"


def daily_keys(t: Tables):
    return t.daily.select("date", "store_id", "sales")


def feat_lag(t: Tables):
    return windows.lag_features(daily_keys(t), group_cols=["store_id"])


def feat_lag_ungrouped(t: Tables):
    """One sequence over all stores, cut into overlapping blocks."""
    daily = t.daily_stage.select("date", "store_id", "sales")
    return windows.lag_features(daily, order_cols=["date", "store_id"], block_rows=5000)


def feat_rolling(t: Tables):
    made = windows.rolling_features(
        t.money_daily.select("date", "store_id", "sales"), group_cols=["store_id"]
    )
    money = [f.name for f in made.schema.fields if f.dataType.typeName() == "decimal"]
    return round_features(made.withColumns({c: F.col(c).cast("double") for c in money}))


def feat_rolling_blocks(t: Tables):
    """The same columns, with every store cut into blocks of rows."""
    daily = t.daily_stage.select(
        "date", "store_id", F.col("sales").cast(facts.MONEY).alias("sales")
    )
    made = windows.rolling_features(daily, group_cols=["store_id"], block_rows=2000)
    money = [f.name for f in made.schema.fields if f.dataType.typeName() == "decimal"]
    return round_features(made.withColumns({c: F.col(c).cast("double") for c in money}))


def fill_group(t: Tables):
    made = windows.lag_features(daily_keys(t), group_cols=["store_id"])
    return fill.fill_sequences(made)


def fill_global(t: Tables):
    made = windows.lag_features(daily_keys(t), group_cols=["store_id"])
    return fill.fill_sequences(materialize(made, "lags"), scope="global")


def all_features_global(t: Tables):
    """The short rolling set and the fill that crosses stores."""
    from tillcast.plans.features import all_features

    made = all_features(
        t.money_daily, t.holidays, windows_=[3], fill_scope="global",
    )
    money = [f.name for f in made.schema.fields if f.dataType.typeName() == "decimal"]
    return round_features(made.withColumns({c: F.col(c).cast("double") for c in money})).select(
        "date", "store_id", "sales", "has_promotion", *LAG_COLUMNS,
        *[c for c in SHORT_COLUMNS if c not in LAG_COLUMNS],
    )


def latest_n_per_store(t: Tables):
    return windows.latest_per_group(t.daily, 30, ["store_id"])


def prediction_point(t: Tables):
    accepted, _ = calendar.split_requests(t.requests)
    points = accepted.select("store_id", F.col("request_date").alias("date"))
    rows = facts.union_facts(
        t.daily.select("date", "store_id", "sales").withColumn("is_request", F.lit(False)),
        points.withColumns({"sales": F.lit(0.0), "is_request": F.lit(True)}),
    ).withColumns(calendar.date_parts())
    return rows.filter("is_request").drop("is_request")


def request_history(t: Tables):
    from tillcast.plans import batch

    accepted, _ = calendar.split_requests(t.requests)
    history = batch.request_history(accepted, t.daily)
    made = history.withColumns(batch.history_features())
    return made.select(
        "store_id", "request_date", F.size("history").alias("rows"),
        *LAG_COLUMNS,
        *[
            F.round(c, 2).alias(c) if c.endswith(("_std", "_mean")) else F.col(c)
            for c in ROLLING_COLUMNS
        ],
    )


def _history_sql() -> str:
    lags = ", ".join(f"max(sales) filter (back = {c.split('_')[-1]}) as {c}" for c in LAG_COLUMNS)
    stats = []
    for c in ROLLING_COLUMNS:
        w, f = c.split("_")[2:]
        call = {"mean": "round(avg(sales) filter ({0}), 2)",
                "std": "round(stddev_samp(sales) filter ({0}), 2)",
                "min": "min(sales) filter ({0})", "max": "max(sales) filter ({0})",
                "median": "quantile_cont(sales, 0.5) filter ({0})"}[f]
        stats.append(call.format(f"back <= {w}") + f" as {c}")
    return f"""select store_id, request_date, cast(count(*) as int) as rows, {lags}, {', '.join(stats)}
        from (select r.store_id, r.request_date, sales, row_number() over (
                partition by r.store_id, r.request_date order by d.date desc) as back
              from (select store_id, try_cast(date as date) as request_date from {{requests}}
                    where regexp_matches(date, '^[0-9]+-[0-9]+-[0-9]+$')) r
              join {{daily}} d on d.store_id = r.store_id and d.date < r.request_date)
        where back <= 30 group by store_id, request_date"""


def feat_interaction(t: Tables):
    return facts.product_day(t.sales).select("date", "store_id", "product_id", "category").withColumns(
        calendar.interactions(["store_id", "product_id", "category"])
    )


def season_rows(t: Tables):
    rows = t.sales.select("date", "product_id").distinct()
    return lookups.lookup_holiday(
        rows.join(t.products, "product_id", "left"), t.holidays
    )


def seasonality_factor(t: Tables):
    return season_rows(t).select(
        "date", "product_id",
        F.round(demand.seasonality_factor("date", "seasonality"), 9).alias("seasonality_factor"),
    )


SEASON_SQL = """case seasonality
    when 'holiday' then case when month(date) in (11, 12)
        then 1.5::double + 0.3::double * sin(2.0::double * pi() * (dayofyear(date) - 300) / 60.0::double)
        when is_holiday then 1.3::double else 1.0::double end
    when 'summer' then 1.0::double + 0.4::double * sin(2.0::double * pi() * (dayofyear(date) - 80) / 365.0::double)
    when 'winter' then 1.0::double + 0.3::double * sin(2.0::double * pi() * (dayofyear(date) + 90) / 365.0::double)
    when 'spring' then 1.0::double + 0.3::double * sin(2.0::double * pi() * (dayofyear(date) - 20) / 365.0::double)
    when 'back_to_school' then case when month(date) in (8, 9) then 1.4::double else 0.9::double end
    when 'fitness' then case when month(date) = 1 then 1.5::double
        when month(date) in (5, 6) then 1.3::double else 1.0::double end
    else 1.0::double end"""
DOW_SQL = "([0.9, 0.85, 0.85, 0.9, 1.1, 1.3, 1.2]::double[])[isodow(date)]"
SIZE_SQL = "(case size when 'large' then 1.0 when 'medium' then 0.7 else 0.5 end)::double"
PRICE_SQL = "(0.5::double + 0.5::double * exp(-price / 500.0::double))"


def dow_factor(t: Tables):
    return t.daily.select("date", "store_id", demand.weekday_factor("date").alias("dow_factor"))


def size_price_factor(t: Tables):
    keys_ = t.sales.select("store_id", "product_id").distinct()
    return lookups.lookup_dims(keys_, t.stores, t.products).select(
        "store_id", "product_id", demand.size_factor("size").alias("size_factor"),
        F.round(demand.price_factor("price"), 9).alias("price_factor"),
    )


def expected_demand(t: Tables):
    rows = t.sales.select("date", "store_id", "product_id").distinct()
    rows = lookups.lookup_dims(rows, t.stores, t.products)
    rows = lookups.lookup_holiday(rows, t.holidays)
    rows = lookups.lookup_store_event(rows, t.store_events)
    rows = lookups.lookup_promo_price(rows, t.promotions)
    made = demand.expected_quantity(demand.expected_traffic(rows))
    return made.select("date", "store_id", "product_id", "expected_traffic", "expected_quantity")


EXPECTED_SQL = f"""select date, store_id, product_id, expected_traffic,
    cast(trunc(expected_traffic * 0.003::double * {SIZE_SQL} * {PRICE_SQL} * ({SEASON_SQL})
        * promotion_factor) as bigint) as expected_quantity
    from (select k.*, size, price, seasonality, is_holiday,
        1.0::double + coalesce(p.discount_percent, 0.0) * 3.0::double as promotion_factor,
        cast(trunc(base_traffic * {DOW_SQL.replace('date', 'k.date')}
          * (case when is_holiday then 1.3 else 1.0 end)::double
          * coalesce(1.0::double + e.impact, 1.0::double)) as bigint) as expected_traffic
      from (select distinct date, store_id, product_id,
              date in (select date from {{holidays}}) as is_holiday from {{sales}}) k
      join {{stores}} using (store_id) join {{products}} using (product_id)
      left join (select store_id as s, date as d, min(impact) as impact from
          (select *, row_number() over (partition by store_id, date order by event_type, impact) as rn
           from {{store_events}}) where rn = 1 group by 1, 2) e
        on e.s = k.store_id and e.d = k.date
      left join (select date as d, product_id as q, discount_percent from
          (select *, row_number() over (partition by date, product_id
             order by promotion_type, discount_percent) as rn from {{promotions}}) where rn = 1) p
        on p.d = k.date and p.q = k.product_id)"""


def price_pnl(t: Tables):
    rows = facts.product_day(t.sales).select("date", "store_id", "product_id", "quantity_sold")
    rows = lookups.lookup_promo_price(rows, t.promotions).join(t.products, "product_id", "left")
    made = demand.price_pnl(rows, "quantity_sold", "price", "discount_percent", "margin")
    return made.select(
        "date", "store_id", "product_id", "quantity_sold", "actual_price", "revenue", "cost", "profit"
    )


def event_promotions(t: Tables):
    """Products sold on an event day, with the event's discount."""
    span = t.sales.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    sold = t.sales.select("date", "product_id").distinct()
    # a handful of event days per year of the span
    return sold.join(F.broadcast(calendar.event_calendar(span)), "date")


EVENTS_SQL = """with s as (select min(cast(l_shipdate as date)) as lo,
        max(cast(l_shipdate as date)) as hi from lineitem),
    e as (select * from (values ('Black Friday', 11, null, 5, 0.25), ('Cyber Monday', 11, 4, 2, 0.20),
        ('Christmas Sale', 12, 15, 10, 0.15), ('New Year Sale', 1, 1, 7, 0.20),
        ('Presidents Day', 2, 15, 3, 0.15), ('Memorial Day', 5, 25, 3, 0.15),
        ('July 4th Sale', 7, 1, 5, 0.15), ('Labor Day', 9, 1, 3, 0.15),
        ('Back to School', 8, 1, 14, 0.10)) v(promotion_type, m, d, days, discount_percent)),
    y as (select lo, hi, unnest(range(year(lo), year(hi) + 1)) as yr from s),
    st as (select lo, hi, promotion_type, days, discount_percent::double as discount_percent,
        case when d is null then make_date(yr, m, 1)
            + cast((4 - isodow(make_date(yr, m, 1)) + 7) % 7 + 22 as int)
          else make_date(yr, m, d) end as start from y, e),
    days as (select lo, hi, promotion_type, discount_percent,
        start + cast(unnest(range(0, days)) as int) as date from st where start between lo and hi)
    select distinct date, l_partkey as product_id, promotion_type, discount_percent
    from days join lineitem on cast(l_shipdate as date) = date where date <= hi"""


def event_days_expand(t: Tables):
    rows = t.store_events.filter(F.col("event_type") == "renovation").select(
        "store_id", F.col("date").alias("start"), "impact",
        (5 + F.col("store_id") % 3).alias("days"),
    )
    return calendar.expand_days(rows, "start", "days")


def forecast_dates(t: Tables):
    last = t.sales.groupBy("store_id").agg(F.date_add(F.max("date"), 1).alias("start"))
    return calendar.forecast_dates(last, "start", 14)


def conf_intervals(t: Tables):
    rows = t.predictions.filter(F.col("model") == "model_b").select("date", "store_id", "prediction")
    return rows.withColumns(intervals.interval_columns("prediction"))


def forecast_pick(t: Tables):
    """Maps of models per key, then the preferred value; the ensemble is left out on Sundays."""
    rows = t.predictions.filter((F.col("model") != "ensemble") | (F.weekday("date") != 6))
    # three models per key at most
    maps = rows.groupBy("date", "store_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "prediction"))).alias("predictions")
    ).withColumn("intervals", F.transform_values(
        "predictions", lambda k, v: intervals.interval_map(v)))
    return maps.select("date", "store_id", *[
        c.alias(n) for n, c in intervals.forecast_pick(
            "predictions", "intervals", ["ensemble", "model_a", "model_b"]).items()
    ])


def key_parts(t: Tables):
    made = t.sales.select("date").distinct().withColumn("key", keys.day_key("sales"))
    return made.withColumns(keys.key_parts("key"))


def encode_label(t: Tables):
    rows = facts.product_day(t.sales).select("date", "store_id", "product_id", "category")
    named = rows.join(t.stores.select("store_id", "location"), "store_id")
    codes = prep.encode_fit(named, ["category", "location"])
    return prep.encode_apply(named, codes, ["category", "location"])


SCALED = ["sales", "customer_traffic", "quantity_sold"]


def scale_standard(t: Tables):
    labelled = split.split_chrono(t.store_day_stage)
    params = prep.scale_fit(labelled.filter(F.col("split") == "train"), SCALED)
    return prep.scale_apply(labelled, params, SCALED).select(
        "date", "store_id", "split", *[F.round(c, 5).alias(c) for c in SCALED]
    )


_SCALE_SQL = ", ".join(
    f"round(({c} - {c}_m) / {c}_s, 5) as {c}" for c in SCALED
)
_SCALE_FIT = ", ".join(f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s" for c in SCALED)

SHORT_COLUMNS = LAG_COLUMNS + [c for c in ROLLING_COLUMNS if "_rolling_3_" in c]


def _global_sql() -> list[str]:
    out = []
    for c in SHORT_COLUMNS:
        text = f"coalesce(last_value({c} ignore nulls) over up, first_value({c} ignore nulls) over whole)"
        out.append(f"round({text}, 2) as {c}" if c.endswith("_std") else f"{text} as {c}")
    return out


QUERIES = {
    "feat_date": (
        lambda t: lookups.lookup_holiday(t.daily.withColumns(calendar.date_parts()), t.holidays),
        sql(f"""select date, store_id, sales, has_promotion,
        date in (select date from {{holidays}}) as is_holiday, {DATE_PARTS_SQL} from {{daily}}""")),
    "feat_cyclical": (
        lambda t: round_features(
            t.daily.select("date", "store_id").withColumns(calendar.cyclical())),
        sql("select * replace (" + ", ".join(f"round({c}, 9) as {c}" for c in CYCLES)
            + f") from (select date, store_id, {CYCLICAL_SQL} from {{daily}})")),
    "feat_interaction": (feat_interaction, sql("""select date, store_id, product_id, category,
        store_id || '_' || product_id as store_id_product_id_interaction,
        store_id || '_' || category as store_id_category_interaction,
        product_id || '_' || category as product_id_category_interaction from {product_day}""")),
    "feat_lag": (feat_lag, sql(
        f"select date, store_id, sales, {', '.join(LAG_COLUMNS)} from {{lagged}}")),
    "feat_lag_ungrouped": (feat_lag_ungrouped, sql(
        "select date, store_id, sales, " + ", ".join(
            f"lag(sales, {c.split('_')[-1]}) over (order by date, store_id) as {c}"
            for c in LAG_COLUMNS) + " from {daily}")),
    "feat_rolling": (feat_rolling, sql(f"""select * replace ({_ROUNDED_STD}) from
        (select date, store_id, sales, {', '.join(ROLLING_COLUMNS)} from {{sequenced}})""")),
    "feat_rolling_blocks": (feat_rolling_blocks, sql(f"""select * replace ({_ROUNDED_STD}) from
        (select date, store_id, sales, {', '.join(ROLLING_COLUMNS)} from {{sequenced}})""")),
    "feat_seasonal_lag": (
        lambda t: windows.seasonal_lag(daily_keys(t)),
        sql("""select d.date, d.store_id, d.sales, p.sales as sales_last_year from {daily} d
        left join {daily} p on p.store_id = d.store_id
          and p.date = cast(d.date - interval 1 year as date)""")),
    "fill_ffill_bfill": (fill_group, sql(
        f"select date, store_id, sales, {', '.join(LAG_COLUMNS)} from {{features}}")),
    "fill_global": (fill_global, sql("select date, store_id, sales, " + ", ".join(
        f"""coalesce(last_value({c} ignore nulls) over up, first_value({c} ignore nulls) over whole) as {c}"""
        for c in LAG_COLUMNS) + """ from {lagged}
        window up as (order by store_id, date rows between unbounded preceding and current row),
        whole as (order by store_id, date rows between unbounded preceding and unbounded following)""")),
    "split_chrono": (
        lambda t: t.daily_split.select("date", "store_id", "split"),
        sql("select date, store_id, split from {daily_split}")),
    "latest_n_per_store": (latest_n_per_store, sql("""select date, store_id, sales, has_promotion,
        is_holiday from (select *, row_number() over (partition by store_id order by date desc) as rn
        from {daily}) where rn <= 30""")),
    "prediction_point": (prediction_point, sql(f"""select date, store_id, 0.0::double as sales,
        {DATE_PARTS_SQL} from (select store_id, try_cast(date as date) as date from {{requests}}
          where regexp_matches(date, '^[0-9]+-[0-9]+-[0-9]+$'))""")),
    "request_history": (request_history, sql(_history_sql())),
    "sort_group_date": (
        lambda t: t.daily.orderBy("store_id", "date"),
        sql("select * from {daily} order by store_id, date")),
    "all_features": (lambda t: round_features(t.features), sql(FEATURES_SQL)),
    "all_features_global": (all_features_global, sql(f"""select date, store_id, sales,
        coalesce(cast(has_promotion as int), 0) as has_promotion, {', '.join(_global_sql())}
        from {{sequenced}}
        window up as (order by store_id, date rows between unbounded preceding and current row),
        whole as (order by store_id, date
                  rows between unbounded preceding and unbounded following)""")),
    "seasonality_factor": (seasonality_factor, sql(f"""select date, product_id,
        round({SEASON_SQL}, 9) as seasonality_factor from (select distinct date, product_id,
        date in (select date from {{holidays}}) as is_holiday from {{sales}})
        join {{products}} using (product_id)""")),
    "dow_factor": (dow_factor, sql(
        f"select date, store_id, {DOW_SQL} as dow_factor from {{daily}}")),
    "size_price_factor": (size_price_factor, sql(f"""select store_id, product_id,
        {SIZE_SQL} as size_factor, round({PRICE_SQL}, 9) as price_factor
        from (select distinct store_id, product_id from {{sales}})
        join {{stores}} using (store_id) join {{products}} using (product_id)""")),
    "expected_demand": (expected_demand, sql(EXPECTED_SQL)),
    "price_pnl": (price_pnl, sql("""select date, store_id, product_id, quantity_sold, actual_price,
        quantity_sold * actual_price as revenue,
        quantity_sold * price * (1.0::double - margin) as cost,
        quantity_sold * actual_price - quantity_sold * price * (1.0::double - margin) as profit
        from (select d.date, d.store_id, d.product_id, d.quantity_sold, price, margin,
          price * (1.0::double - coalesce(p.discount_percent, 0.0)) as actual_price
          from {product_day} d join {products} using (product_id)
          left join (select * from (select *, row_number() over (partition by date, product_id
              order by promotion_type, discount_percent) as rn from {promotions}) where rn = 1) p
            on p.date = d.date and p.product_id = d.product_id)""")),
    "days_of_supply": (
        lambda t: demand.days_of_supply(t.inventory_daily),
        sql("""select *, inventory_level / greatest(1.0::double, quantity_sold) as days_of_supply,
        inventory_level <= reorder_point as needs_reorder from {inventory_daily}""")),
    "event_calendar": (event_promotions, EVENTS_SQL),
    "event_days_expand": (event_days_expand, sql("""select store_id, date as start, impact,
        5 + store_id % 3 as days, date + cast(unnest(range(0, 5 + store_id % 3)) as int) as date
        from {store_events} where event_type = 'renovation'""")),
    "forecast_dates": (forecast_dates, sql("""select store_id, last + 1 as start,
        strftime(last + 1 + cast(unnest(range(0, 14)) as int), '%Y-%m-%d') as date
        from {last_sale}""")),
    "parse_request_date": (
        lambda t: t.requests.withColumn("request_date", calendar.parse_request_date("date")),
        sql("""select store_id, date, case when regexp_matches(date, '^[0-9]+-[0-9]+-[0-9]+$')
        then try_cast(date as date) end as request_date from {requests}""")),
    "conf_intervals": (conf_intervals, sql(f"""select date, store_id, prediction,
        {band('-', '1.28')} as lower_80, {band('+', '1.28')} as upper_80,
        {band('-', '1.96')} as lower_95, {band('+', '1.96')} as upper_95
        from {{predictions}} where model = 'model_b'""")),
    "forecast_pick": (forecast_pick, sql(f"""select date, store_id, prediction,
        {band('-', '1.96')} as lower, {band('+', '1.96')} as upper
        from {{predictions}} where model = case when isodow(date) = 7 then 'model_a'
        else 'ensemble' end""")),
    "key_parts": (key_parts, sql("""select date,
        strftime(date, 'sales/year=%Y/month=%m/day=%d/sales_%Y-%m-%d.parquet') as key,
        'sales' as top_folder, strftime(date, 'sales_%Y-%m-%d.parquet') as file_name,
        strftime(date, '%Y-%m-%d') as file_date, true as is_parquet
        from (select distinct date from {sales})""")),
    "encode_label": (encode_label, sql("""select date, store_id, product_id,
        c.code as category, l.code as location from {product_day} join {stores} using (store_id)
        join (select category as cat, cast(dense_rank() over (order by category) - 1 as int) as code
              from (select distinct category from {product_day})) c on cat = category
        join (select location as loc, cast(dense_rank() over (order by location) - 1 as int) as code
              from (select distinct location from {product_day} join {stores} using (store_id))) l
          on loc = location""")),
    "scale_standard": (scale_standard, sql(f"""select date, store_id, split, {_SCALE_SQL}
        from {{store_day}} join (select date, store_id, split from {{daily_split}})
          using (date, store_id),
        (select {_SCALE_FIT} from {{store_day}} join (select date, store_id, split from {{daily_split}})
         using (date, store_id) where split = 'train')""")),
}
