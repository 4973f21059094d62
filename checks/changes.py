"""Deliveries: discovered files, the refreshed daily table, the streamed one."""

from pyspark.sql import functions as F

from checks.views import Tables, sql
from tillcast.plans import refresh
from tillcast.session import materialize, scratch_path
from tillcast.sources import discovery, sinks
from tillcast.streaming import daily as stream

SALES = (
    "date date, store_id bigint, product_id bigint, category string, quantity_sold double, "
    "unit_price double, discount_percent double, revenue double, cost double, profit double"
)
PROMOTIONS = "date date, product_id bigint, promotion_type string, discount_percent double"
TRAFFIC = "date date, store_id bigint, customer_traffic bigint, is_holiday boolean"


def refresh_daily(t: Tables):
    """Two deliveries in months: the first lacks the sales of one product in 2,000, the second brings
    the months of those sales anew, with the corrected days."""
    root = scratch_path(t.spark, "deliveries")
    inputs = refresh.Inputs(
        f"{root}/sales", f"{root}/promotions", f"{root}/traffic",
        {"sales": SALES, "promotions": PROMOTIONS, "traffic": TRAFFIC}, unit="month",
    )
    held_back = F.col("product_id") % 2_000 == 3
    sinks.write_by_unit(t.sales.filter(~held_back), inputs.sales, "month")
    sinks.write_by_unit(t.promotions, inputs.promotions, "month")
    sinks.write_by_unit(t.customer_traffic, inputs.traffic, "month")
    refresh.refresh_daily(t.spark, inputs, f"{root}/daily", f"{root}/log")
    month = F.trunc("date", "month")
    corrected = t.sales.filter(held_back).select(month.alias("month")).distinct()
    again = t.sales.withColumn("month", month).join(corrected, "month", "left_semi").drop("month")
    sinks.write_by_unit(again, inputs.sales, "month")
    units = refresh.refresh_daily(t.spark, inputs, f"{root}/daily", f"{root}/log")
    return refresh.read_daily(t.spark, f"{root}/daily").withColumn("refreshed", refresh.unit_number("month", "date").isin(units))


def stream_store_day(t: Tables):
    """Three deliveries of files, each with sales of all days, so that the later ones come late."""
    root = scratch_path(t.spark, "arriving")
    rows = t.sales.withColumn("delivery", F.col("product_id") % 3)
    for k in range(3):
        sinks.write_table(rows.filter(F.col("delivery") == k).drop("delivery"), f"{root}/in/delivery{k}")
        query = stream.deliver_daily(
            stream.read_sales_stream(t.spark, f"{root}/in", SALES), f"{root}/out", f"{root}/checkpoint", unit="month"
        )
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return stream.read_delivered(t.spark, f"{root}/out")


def discover_files(t: Tables):
    """Files of three looks at a folder of monthly files: some come, one year is written anew, one goes."""
    path, log = scratch_path(t.spark, "months"), scratch_path(t.spark, "log")
    rows = t.sales.select("date", "store_id", "revenue").withColumns({"year": F.year("date"), "month": F.month("date")})
    write = lambda part, mode: part.repartition("year", "month").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    write(rows.filter("year < 1998"), "overwrite")
    looks = []

    def look(number):
        found = discovery.discover(t.spark, path, log)
        changed = discovery.scan_changed(t.spark, found, "date date, store_id bigint, revenue double", path)
        per_file = changed.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        month = F.concat_ws("-", *[F.regexp_extract("path", rf"/{p}=(\d+)/", 1) for p in ("year", "month")])
        made = found.filter("change <> 'same'").join(per_file, "path", "left")
        made = made.select(F.lit(number).alias("look"), month.alias("month"), "change", F.coalesce("rows", F.lit(0)).alias("rows"))
        looks.append(materialize(made, "look"))  # before the next delivery replaces files
        discovery.commit(found, log)

    look(0)
    write(rows.filter("year >= 1998"), "append")
    write(rows.filter("year = 1996 and store_id % 2 = 0"), "overwrite")
    look(1)
    look(2)
    return looks[0].unionByName(looks[1]).unionByName(looks[2])


MONTHS_SQL = """(select strftime(date, '%Y-%-m') as month, year(date) as y, count(*) as n,
    count(*) filter (store_id % 2 = 0) as even from {sales} group by all)"""
QUERIES = {
    "refresh_daily": (refresh_daily, sql("""select d.*, date_trunc('month', date) in (select date_trunc('month', date)
        from {sales} where product_id % 2000 = 3) as refreshed from {daily} d""")),
    "stream_store_day": (stream_store_day, sql("""select date, store_id, sum(quantity_sold) as quantity_sold,
        cast(sum(cast(revenue as decimal(18,4))) as double) as sales,
        cast(sum(cast(profit as decimal(18,4))) as double) as profit, count(*) as rows,
        date + 7 <= (select max(date) from {sales}) as finished from {sales} group by date, store_id""")),
    "discover_files": (discover_files, sql(f"""select 0 as look, month, 'new' as change, n as rows
        from {MONTHS_SQL} where y < 1998
        union all select 1, month, 'new', n from {MONTHS_SQL} where y >= 1998
        union all select 1, month, 'gone', 0 from {MONTHS_SQL} where y = 1996 and even > 0
        union all select 1, month, 'new', even from {MONTHS_SQL} where y = 1996 and even > 0""")),
}
