"""Retail views over the test tables: as DataFrames, and as SQL to check them against."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillcast.operators import evaluate, facts, registry, split, windows
from tillcast.plans.daily import daily_store_sales
from tillcast.plans.features import all_features
from tillcast.functions import calendar
from tillcast.session import materialize

HOLIDAY_CODES = [101, 430, 501, 902]  # fixed values: month * 100 + day
SEASONS = ["holiday", "summer", "winter", "back_to_school", "fitness", "spring", "all_year"]


def month_day(date):
    return F.month(date) * 100 + F.day(date)


class Tables:
    """The views of one scale-factor folder.

    A view is a plan. The daily table and the predictions also exist as stored stages, written
    anew for each query, for operators that read their input more than once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.raw("lineitem").withColumn("date", F.to_date("l_shipdate"))

    @cached_property
    def store_lines(self) -> DataFrame:
        lines = self.lineitem.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def sales(self) -> DataFrame:
        revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        cost = F.col("l_extendedprice") * F.lit(0.7)
        return self.store_lines.select(
            "date",
            F.col("s_nationkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("l_quantity").alias("quantity_sold"),
            F.col("p_retailprice").alias("unit_price"),
            F.col("l_discount").alias("discount_percent"),
            revenue.alias("revenue"),
            cost.alias("cost"),
            (revenue - cost).alias("profit"),
        )

    @cached_property
    def promotions(self) -> DataFrame:
        return self.lineitem.filter(F.col("l_discount") >= 0.08).select(
            "date",
            F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_discount") >= 0.1, "Clearance").otherwise("Flash Sale")
            .alias("promotion_type"),
            F.col("l_discount").alias("discount_percent"),
        )

    @cached_property
    def store_orders(self) -> DataFrame:
        orders = self.raw("orders").withColumn("date", F.to_date("o_orderdate"))
        return orders.join(
            self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).withColumn("store_id", F.col("c_nationkey"))

    @cached_property
    def customer_traffic(self) -> DataFrame:
        return self.store_orders.groupBy("date", "store_id").agg(
            F.count(F.lit(1)).alias("customer_traffic"),
            F.max(month_day("date").isin(HOLIDAY_CODES)).alias("is_holiday"),
        )

    @cached_property
    def store_events(self) -> DataFrame:
        closed = F.col("o_orderstatus") == "F"
        return self.store_orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
            "store_id", "date",
            F.when(closed, "closure").otherwise("renovation").alias("event_type"),
            F.when(closed, -1.0).otherwise(-0.3).alias("impact"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        return (
            self.lineitem.filter(month_day("date").isin(HOLIDAY_CODES)).select("date").distinct()
        )

    @cached_property
    def inventory_daily(self) -> DataFrame:
        return self.store_lines.select(
            "date",
            F.col("s_nationkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            (50 + F.col("p_size")).alias("inventory_level"),
            (20 + F.col("p_size") % 31).alias("reorder_point"),
            F.col("l_quantity").alias("quantity_sold"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.raw("nation").select(
            key.alias("store_id"),
            F.col("n_name").alias("location"),
            F.when(key % 3 == 0, "large").when(key % 3 == 1, "medium").otherwise("small")
            .alias("size"),
            (300 + 40 * key).alias("base_traffic"),
        )

    @cached_property
    def products(self) -> DataFrame:
        seasons = F.array(*[F.lit(s) for s in SEASONS])
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.element_at(seasons, F.col("p_size") % 7 + 1).alias("seasonality"),
            F.col("p_retailprice").alias("price"),
            (F.lit(0.1) + F.lit(0.01) * (F.col("p_size") % 40)).alias("margin"),
        )

    @cached_property
    def store_day(self) -> DataFrame:
        return daily_store_sales(
            self.sales, self.promotions, self.customer_traffic, keep_all=True
        )

    @cached_property
    def daily(self) -> DataFrame:
        return daily_store_sales(self.sales, self.promotions, self.customer_traffic)

    @cached_property
    def daily_stage(self) -> DataFrame:
        return materialize(self.daily, "daily")

    @cached_property
    def store_day_stage(self) -> DataFrame:
        return materialize(self.store_day, "store-day")

    @cached_property
    def prediction_stage(self) -> DataFrame:
        return materialize(self.predictions, "predictions")

    @cached_property
    def money_daily(self) -> DataFrame:
        """Daily table with decimal sales, so that window sums are exact."""
        return self.daily.withColumn("sales", F.col("sales").cast(facts.MONEY))

    @cached_property
    def daily_split(self) -> DataFrame:
        return split.split_chrono(self.daily_stage)

    @cached_property
    def features(self) -> DataFrame:
        """Features over decimal sales; money columns come back as doubles."""
        made = all_features(self.money_daily, self.holidays)
        money = [f.name for f in made.schema.fields if f.dataType.typeName() == "decimal"]
        return made.withColumns({c: F.col(c).cast("double") for c in money})

    @cached_property
    def predictions(self) -> DataFrame:
        """Naive predictors: yesterday's row, mean of three rows, and their mean."""
        made = windows.sequence_features(
            self.money_daily.select("date", "store_id", "sales"), group_cols=["store_id"],
            lags=[1], windows=[3], functions=["mean"],
        ).filter(F.col("sales_lag_1").isNotNull())
        single = made.select(
            "date", "store_id", F.col("sales").cast("double").alias("actual"),
            F.inline(F.array(
                F.struct(F.lit("model_a").alias("model"),
                         F.col("sales_lag_1").cast("double").alias("prediction")),
                F.struct(F.lit("model_b").alias("model"),
                         F.col("sales_rolling_3_mean").alias("prediction")),
            )),
        )
        single = materialize(single, "single")
        both = evaluate.ensemble_predict(single, None, ("date", "store_id", "actual"))
        return single.unionByName(both.withColumn("model", F.lit("ensemble")))

    @cached_property
    def store_metrics(self) -> DataFrame:
        """(store_id, model, metric, value) to 4 digits, as a stored table."""
        metrics = evaluate.regression_metrics(self.predictions, ["store_id", "model"])
        rows = evaluate.metrics_long(metrics, ["store_id", "model"])
        return materialize(rows.withColumn("value", F.round("value", 4)), "metrics")

    @cached_property
    def runs(self) -> DataFrame:
        """One run per store and month of model_a, as (name, version, run_id, metric, value)."""
        monthly = self.predictions.filter(F.col("model") == "model_a").withColumn(
            "version", (F.year("date") - 1995) * 12 + F.month("date")
        )
        metrics = evaluate.regression_metrics(monthly, ["store_id", "version"])
        name = F.concat(F.lit("store_"), F.col("store_id").cast("string"))
        return metrics.select(
            "store_id", name.alias("name"), F.col("version").cast("bigint").alias("version"),
            F.concat(name, F.lit("_run_"), F.col("version").cast("string")).alias("run_id"),
            F.lit("rmse").alias("metric"), F.round("rmse", 4).alias("value"),
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        v = F.col("version")
        return self.runs.select(
            "name", "version", "run_id",
            F.when(F.col("store_id") % 5 == 0,
                   F.when(v % 2 == 0, "Staging").otherwise("None"))
            .when(v % 3 == 0, "Production").when(v % 3 == 1, "Staging").otherwise("Archived")
            .alias("stage"),
        )

    @cached_property
    def importances(self) -> DataFrame:
        """(model, feature, importance): strength of each lag per store, the store as model."""
        from tillcast.operators.diagnose import correlations

        made = windows.lag_features(
            self.daily.select("date", "store_id", "sales"), group_cols=["store_id"]
        )
        lags = [c for c in made.columns if "lag" in c]
        return correlations(made, lags, "sales", ["store_id"]).select(
            F.col("store_id").alias("model"), "feature",
            F.round(F.abs("corr"), 6).alias("importance"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Seven days after each store's last sale, and one malformed date per store."""
        last = self.sales.groupBy("store_id").agg(F.max("date").alias("last"))
        good = calendar.forecast_dates(
            last.withColumn("start", F.date_add("last", 1)), "start", 7
        ).select("store_id", "date")
        bad = last.select("store_id", F.date_format("last", "yyyy/MM/dd").alias("date"))
        return good.unionByName(bad)


# --- the same views in SQL; each may use the ones before it ---

_LAGS = ", ".join(
    f"lag(sales, {k}) over w as sales_lag_{k}" for k in [1, 2, 3, 7, 14, 21, 30]
)


def _rolling(w: int) -> str:
    frame = f"over (partition by store_id order by date rows between {w} preceding and 1 preceding)"
    money = "cast(sales as decimal(18,4))"
    return ", ".join(
        [
            f"cast(sum({money}) {frame} as double) / nullif(count(sales) {frame}, 0) as sales_rolling_{w}_mean",
            f"stddev_samp(sales) {frame} as sales_rolling_{w}_std",
            f"min(sales) {frame} as sales_rolling_{w}_min",
            f"max(sales) {frame} as sales_rolling_{w}_max",
            f"quantile_cont(sales, 0.5) {frame} as sales_rolling_{w}_median",
        ]
    )


WINDOWS = [3, 7, 14, 21, 30]
SEQUENCE_COLUMNS = [f"sales_lag_{k}" for k in [1, 2, 3, 7, 14, 21, 30]] + [
    f"sales_rolling_{w}_{f}" for w in WINDOWS for f in ["mean", "std", "min", "max", "median"]
]
_ROLLING = ", ".join(_rolling(w) for w in WINDOWS)
_FILLED = ", ".join(
    f"coalesce(last_value({c} ignore nulls) over up, first_value({c} ignore nulls) over whole) as {c}"
    for c in SEQUENCE_COLUMNS
)
DATE_PARTS_SQL = """cast(year(date) as int) as year, cast(month(date) as int) as month,
    cast(day(date) as int) as day, cast(isodow(date) - 1 as int) as dayofweek,
    cast(quarter(date) as int) as quarter, cast(weekofyear(date) as int) as weekofyear,
    case when isodow(date) >= 6 then 1 else 0 end as is_weekend"""
CYCLICAL_SQL = ", ".join(
    f"{f}(2.0::double * pi() * {part} / {period}.0::double) as {name}_{f}"
    for name, part, period in [
        ("day", "day(date)", 31), ("month", "month(date)", 12),
        ("dayofweek", "(isodow(date) - 1)", 7),
    ]
    for f in ["sin", "cos"]
)

VIEWS = {
    "sales": """select cast(l_shipdate as date) as date, s_nationkey as store_id,
        l_partkey as product_id, p_type as category, l_quantity as quantity_sold,
        p_retailprice as unit_price, l_discount as discount_percent,
        l_extendedprice * (1 - l_discount) as revenue,
        l_extendedprice * cast(0.7 as double) as cost,
        l_extendedprice * (1 - l_discount) - l_extendedprice * cast(0.7 as double) as profit
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "promotions": """select cast(l_shipdate as date) as date, l_partkey as product_id,
        case when l_discount >= 0.1 then 'Clearance' else 'Flash Sale' end as promotion_type,
        l_discount as discount_percent from lineitem where l_discount >= 0.08""",
    "customer_traffic": """select date, store_id, count(*) as customer_traffic,
        max(month(date) * 100 + day(date) in (101, 430, 501, 902)) as is_holiday
        from (select cast(o_orderdate as date) as date, c_nationkey as store_id
              from orders join customer on o_custkey = c_custkey) x
        group by date, store_id""",
    "store_events": """select c_nationkey as store_id, cast(o_orderdate as date) as date,
        case when o_orderstatus = 'F' then 'closure' else 'renovation' end as event_type,
        cast(case when o_orderstatus = 'F' then -1.0 else -0.3 end as double) as impact
        from orders join customer on o_custkey = c_custkey
        where o_orderpriority = '1-URGENT'""",
    "holidays": """select distinct cast(l_shipdate as date) as date from lineitem
        where month(l_shipdate) * 100 + day(l_shipdate) in (101, 430, 501, 902)""",
    "inventory_daily": """select cast(l_shipdate as date) as date, s_nationkey as store_id,
        l_partkey as product_id, 50 + p_size as inventory_level,
        20 + (p_size % 31) as reorder_point, l_quantity as quantity_sold
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "stores": """select n_nationkey as store_id, n_name as location,
        case n_nationkey % 3 when 0 then 'large' when 1 then 'medium' else 'small' end as size,
        300 + 40 * n_nationkey as base_traffic from nation""",
    "products": """select p_partkey as product_id,
        case p_size % 7 when 0 then 'holiday' when 1 then 'summer' when 2 then 'winter'
          when 3 then 'back_to_school' when 4 then 'fitness' when 5 then 'spring'
          else 'all_year' end as seasonality,
        p_retailprice as price,
        cast(0.1 as double) + cast(0.01 as double) * (p_size % 40) as margin from part""",
    "product_day": """select date, store_id, product_id, category,
        sum(quantity_sold) as quantity_sold,
        cast(sum(cast(revenue as decimal(18,4))) as double) as sales,
        cast(sum(cast(cost as decimal(18,4))) as double) as cost,
        cast(sum(cast(profit as decimal(18,4))) as double) as profit,
        round(avg(discount_percent), 9) as discount_percent, round(avg(unit_price), 9) as unit_price
        from {sales} group by all""",
    "promo_summary": """select date, product_id, max(discount_percent) as max_discount,
        1 as has_promotion from {promotions} group by date, product_id""",
    "traffic_day": """select date, store_id, cast(sum(customer_traffic) as bigint) as customer_traffic,
        max(is_holiday) as is_holiday from {customer_traffic} group by date, store_id""",
    "store_day": """select date, store_id, sum(quantity_sold) as quantity_sold,
        cast(sum(cast(sales as decimal(18,4))) as double) as sales,
        cast(sum(cast(profit as decimal(18,4))) as double) as profit,
        avg(has_promotion) as has_promotion, max(customer_traffic) as customer_traffic,
        max(is_holiday) as is_holiday
        from {product_day} left join {promo_summary} using (date, product_id)
        left join {traffic_day} using (date, store_id)
        group by date, store_id""",
    "daily": "select date, store_id, sales, has_promotion, is_holiday from {store_day}",
    "daily_split": """select d.*, case when rn <= trunc(n * 0.7::double) then 'train'
        when rn <= trunc(n * 0.7::double) + trunc(n * 0.15::double) then 'val' else 'test' end as split
        from (select *, row_number() over (order by date, store_id) as rn,
              count(*) over () as n from {daily}) d""",
    "lagged": f"select *, {_LAGS} from {{daily}} window w as (partition by store_id order by date)",
    "sequenced": f"select *, {_ROLLING} from {{lagged}}",
    "features": f"""select date, store_id, sales, coalesce(cast(has_promotion as int), 0) as has_promotion,
        date in (select date from {{holidays}}) as is_holiday,
        {DATE_PARTS_SQL}, {CYCLICAL_SQL}, {_FILLED}
        from {{sequenced}}
        window up as (partition by store_id order by date
                      rows between unbounded preceding and current row),
               whole as (partition by store_id order by date
                         rows between unbounded preceding and unbounded following)""",
    "naive": """select date, store_id, sales as actual, lag(sales) over w as a,
        cast(sum(cast(sales as decimal(18,4))) over (partition by store_id order by date
             rows between 3 preceding and 1 preceding) as double)
        / nullif(count(sales) over (partition by store_id order by date
             rows between 3 preceding and 1 preceding), 0) as b
        from {daily} window w as (partition by store_id order by date)""",
    "predictions": """select date, store_id, actual, 'model_a' as model, a as prediction
          from {naive} where a is not null
        union all select date, store_id, actual, 'model_b', b from {naive} where a is not null
        union all select date, store_id, actual, 'ensemble', (a + b) / 2.0::double
          from {naive} where a is not null""",
    "scores": """select store_id, model, sqrt(avg((actual - prediction) ** 2)) as rmse,
        avg(abs(actual - prediction)) as mae,
        avg(case when actual <> 0 then abs(actual - prediction) / abs(actual) end) * 100 as mape,
        avg(abs(actual - prediction)) * 100 as mae_x100,
        1 - avg((actual - prediction) ** 2) / nullif(var_pop(actual), 0) as r2, count(*) as n
        from {predictions} group by store_id, model""",
    "store_metrics": """select store_id, model, metric, round(value, 4) as value
        from (unpivot (select store_id, model, rmse, mae, mape, mae_x100, r2 from {scores})
              on rmse, mae, mape, mae_x100, r2 into name metric value value)""",
    "runs": """select store_id, 'store_' || store_id as name, version,
        'store_' || store_id || '_run_' || version as run_id, 'rmse' as metric,
        round(sqrt(avg((actual - prediction) ** 2)), 4) as value
        from (select *, (year(date) - 1995) * 12 + month(date) as version
              from {predictions} where model = 'model_a') p
        group by store_id, version""",
    "model_versions": """select name, version, run_id, case when store_id % 5 = 0
          then case when version % 2 = 0 then 'Staging' else 'None' end
          when version % 3 = 0 then 'Production' when version % 3 = 1 then 'Staging'
          else 'Archived' end as stage from {runs}""",
    "importances": """select store_id as model, feature, round(abs(c), 6) as importance
        from (unpivot (select store_id, """
    + ", ".join(f"corr(sales_lag_{k}, sales) as sales_lag_{k}" for k in [1, 2, 3, 7, 14, 21, 30])
    + """ from {lagged} group by store_id)
        on """
    + ", ".join(f"sales_lag_{k}" for k in [1, 2, 3, 7, 14, 21, 30])
    + """ into name feature value c)""",
    "last_sale": "select store_id, max(date) as last from {sales} group by store_id",
    "requests": """select store_id, strftime(last + cast(i as int), '%Y-%m-%d') as date
        from {last_sale}, range(1, 8) r(i)
        union all select store_id, strftime(last, '%Y/%m/%d') from {last_sale}""",
    "residuals": """select *, actual - prediction as residual from {predictions}""",
}


def band(sign: str, z: str) -> str:
    """A bound to 2 decimals. Like Spark, it rounds the printed digits of the double, half up."""
    bound = f"prediction {sign} {z}::double * (prediction * 0.1::double)"
    return f"cast(round(cast(cast({bound} as varchar) as decimal(30, 12)), 2) as double)"


def sql(body: str) -> str:
    """A statement whose ``{view}`` names are defined by a WITH clause in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    visit(body)
    if not needed:
        return plain(body)
    views = ",\n".join(f"{n} as materialized ({plain(VIEWS[n])})" for n in needed)
    return f"with {views}\n{plain(body)}"
