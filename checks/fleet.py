"""Lasting store events, versions as of a date, and one regression per store."""

from pyspark.sql import functions as F

from checks.views import Tables, sql
from tillcast.operators import evaluate, fleet, lookups, registry, windows
from tillcast.session import materialize

FEATURES = {"yesterday": ["sales_lag_1"], "week": ["sales_lag_1", "sales_lag_7"]}


def lasting_events(t: Tables):
    """Urgent orders as events of up to six weeks; one in seven is still open."""
    key = F.col("o_orderkey")
    closed = F.col("o_orderstatus") == "F"
    return t.store_orders.filter("o_orderpriority = '1-URGENT' and o_orderkey % 5 = 1").select(
        "store_id", F.col("date").alias("start"),
        F.when(key % 7 != 0, F.date_add("date", (key % 43).cast("int"))).alias("end"),
        F.when(closed, "closure").otherwise("renovation").alias("event_type"),
        (F.when(closed, -1.0).otherwise(-0.3) + (key % 10) / 100.0).alias("impact"),
    )


def lookup_store_interval(t: Tables):
    return lookups.lookup_store_interval(t.daily_stage.select("date", "store_id"), lasting_events(t))


def stage_changes(t: Tables):
    """A version's stage from the first of its month on; every third is archived 40 days later."""
    start = F.make_date((F.lit(1995) + F.floor((F.col("version") - 1) / 12)).cast("int"), ((F.col("version") - 1) % 12 + 1).cast("int"), F.lit(1))
    made = t.model_versions.withColumn("date", start)
    ended = made.filter((F.col("stage") == "Production") & (F.col("version") % 9 == 0))
    return made.unionByName(ended.withColumns({"stage": F.lit("Archived"), "date": F.date_add("date", 40)}))


def version_as_of(t: Tables):
    """The version in Production on the day of every change, the day before it, and 20 days later."""
    changes = materialize(stage_changes(t), "changes")
    days = F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 20))
    points = changes.select("name", F.explode(days).alias("date")).distinct()
    return registry.version_as_of(materialize(points, "points"), changes)


def fleet_rows(t: Tables):
    """The daily rows with two lags and their split, stored."""
    lagged = windows.lag_features(t.daily.select("date", "store_id", "sales"), group_cols=["store_id"])
    split = t.daily_split.select("date", "store_id", "split")
    return materialize(lagged.select("date", "store_id", "sales", "sales_lag_1", "sales_lag_7").join(split, ["date", "store_id"]), "fleet")


def trained(t: Tables):
    return fleet.train_fleet(fleet_rows(t), ["store_id"], FEATURES, "sales", ["date", "store_id"])


def fleet_fit(t: Tables):
    rows = fleet_rows(t).filter("split = 'train'")
    made = fleet.fit(rows, ["store_id"], FEATURES["week"], "sales")
    return made.select(
        "store_id", "n", F.round("intercept", 3).alias("intercept"),
        *[F.round(c, 6).alias(c) for c in ("coef_sales_lag_1", "coef_sales_lag_7", "r2")],
    )


def fleet_predict(t: Tables):
    _, predictions = trained(t)
    return predictions.filter("prediction is not null").withColumn("prediction", F.round("prediction", 3))


def fleet_weights(t: Tables):
    _, predictions = trained(t)
    metrics = evaluate.regression_metrics(predictions.filter("split = 'val'"), ["store_id", "model"])
    return evaluate.ensemble_weights(metrics, ["store_id"]).withColumn("weight", F.round("weight", 6))


def fleet_best(t: Tables):
    _, predictions = trained(t)
    metrics = evaluate.regression_metrics(predictions.filter("split = 'test'"), ["store_id", "model"])
    return registry.best_model(metrics, ["store_id"]).withColumn("best_rmse", F.round("best_rmse", 3))


ROWS_SQL = "(select l.*, split from {lagged} l join {daily_split} using (date, store_id))"
_STATS = """select store_id, count(*) as n, avg(x) as mx, avg(z) as mz, avg(sales) as my,
    covar_pop(x, x) as xx, covar_pop(x, z) as xz, covar_pop(z, z) as zz, covar_pop(x, sales) as xy,
    covar_pop(z, sales) as zy, var_pop(sales) as yy
    from (select store_id, sales, sales_lag_1 as x, sales_lag_7 as z from {rows} where split = 'train'
      and sales_lag_1 is not null and sales_lag_7 is not null and sales is not null) group by store_id"""
FIT_SQL = f"""(select store_id, n, (xy * zz - zy * xz) / (xx * zz - xz * xz) as a,
    (zy * xx - xy * xz) / (xx * zz - xz * xz) as b, mx, mz, my, xy, zy, yy from ({_STATS.replace("{rows}", ROWS_SQL)}))"""
PREDICTED_SQL = f"""(select date, store_id, split, 'week' as model, sales as actual,
      my - a * mx - b * mz + a * sales_lag_1 + b * sales_lag_7 as prediction
      from {ROWS_SQL} join {FIT_SQL} using (store_id) where split <> 'train'
    union all select date, store_id, split, 'yesterday', sales, c + m * sales_lag_1
      from {ROWS_SQL} join (select store_id, regr_slope(sales, sales_lag_1) as m,
        regr_intercept(sales, sales_lag_1) as c from {ROWS_SQL} where split = 'train' group by store_id) using (store_id)
      where split <> 'train')"""
_SCORED = f"""(select store_id, model, sqrt(avg((actual - prediction) ** 2)) as rmse,
    1 - avg((actual - prediction) ** 2) / nullif(var_pop(actual), 0) as r2
    from {PREDICTED_SQL} where split = 'PART' and prediction is not null group by store_id, model)"""

QUERIES = {
    "lookup_store_interval": (lookup_store_interval, sql("""select date, store_id,
        coalesce(1.0::double + arg_min(impact, (-epoch(start), event_type, impact)), 1.0::double) as event_impact
        from {daily} left join (select c_nationkey as s, cast(o_orderdate as date) as start,
          case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 43 as int) end as stop,
          case when o_orderstatus = 'F' then 'closure' else 'renovation' end as event_type,
          case when o_orderstatus = 'F' then -1.0::double else -0.3::double end + (o_orderkey % 10) / 100.0::double as impact
          from orders join customer on o_custkey = c_custkey
          where o_orderpriority = '1-URGENT' and o_orderkey % 5 = 1) e
        on store_id = s and date >= start and date <= coalesce(stop, date) group by date, store_id""")),
    "version_as_of": (version_as_of, sql("""select p.name, p.date, a.version, a.run_id
        from (select distinct name, date + cast(d as int) as date from (
            select name, make_date(1995 + (version - 1) // 12, (version - 1) % 12 + 1, 1) as date from {model_versions}
            union all select name, make_date(1995 + (version - 1) // 12, (version - 1) % 12 + 1, 1) + 40 from {model_versions}
              where stage = 'Production' and version % 9 = 0), (values (-1), (0), (20)) k(d)) p
        asof left join (select name, version, run_id, make_date(1995 + (version - 1) // 12, (version - 1) % 12 + 1, 1) as start,
            make_date(1995 + (version - 1) // 12, (version - 1) % 12 + 1, 1) + case when version % 9 = 0 then 39 else 100000 end as stop
          from {model_versions} where stage = 'Production') s on p.name = s.name and p.date >= s.start
        left join lateral (select case when p.date <= s.stop then s.version end as version,
          case when p.date <= s.stop then s.run_id end as run_id) a on true""")),
    "fleet_fit": (fleet_fit, sql(f"""select store_id, n, round(my - a * mx - b * mz, 3) as intercept,
        round(a, 6) as coef_sales_lag_1, round(b, 6) as coef_sales_lag_7, round((a * xy + b * zy) / yy, 6) as r2
        from {FIT_SQL}""")),
    "fleet_predict": (fleet_predict, sql(f"""select date, store_id, split, model, actual, round(prediction, 3) as prediction
        from {PREDICTED_SQL} where prediction is not null""")),
    "fleet_weights": (fleet_weights, sql(f"""select store_id, model,
        round(raw / sum(raw) over (partition by store_id), 6) as weight
        from (select *, greatest(0.2::double, coalesce(score / nullif(sum(score) over (partition by store_id), 0),
          1.0::double / count(*) over (partition by store_id))) as raw
          from (select store_id, model, greatest(coalesce(r2, 0), 0) as score from {_SCORED.replace("PART", "val")}))""")),
    "fleet_best": (fleet_best, sql(f"""select store_id, arg_min(model, (rmse, model)) as best_model,
        round(min(rmse), 3) as best_rmse from {_SCORED.replace("PART", "test")} group by store_id""")),
}
