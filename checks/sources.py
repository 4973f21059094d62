"""Scans, sinks and data quality."""

from pyspark.sql import functions as F

from checks.views import Tables, sql
from tillcast.operators import facts, lookups, prep, quality
from tillcast.session import scratch_path
from tillcast.sources import files, sinks

# "part" is the last: other names and file names contain it
TABLES = ["lineitem", "orders", "customer", "supplier", "nation", "region", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations", "part"]

LINES = (
    "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_shipdate timestamp_ntz"
)


def scan_facts(t: Tables):
    rows = files.scan_facts(t.spark, f"{t.dir}/lineitem.parquet", LINES)
    return rows.withColumn("date", F.to_date("l_shipdate")).drop("l_shipdate")


def scan_facts_dated(t: Tables):
    """Some weeks out of dated folders, through the folder bounds."""
    path = scratch_path(t.spark, "dated")
    sold = t.sales.select("date", "store_id", "product_id", "revenue")
    sinks.write_by_day(sold, path)
    schema = "date date, store_id bigint, product_id bigint, revenue double"
    return files.scan_facts(t.spark, path, schema, "1997-01-15", "1997-02-10", partitioned=True)


def catalogued(t: Tables):
    catalog = files.file_catalog(t.spark, t.dir, TABLES)
    return files.with_rows(catalog, files.files_with_rows(t.spark, t.dir))


def file_catalog(t: Tables):
    return catalogued(t).select("data_type", "key", "rows")


def catalog_counts(t: Tables):
    return files.catalog_counts(catalogued(t))


def type_coverage(t: Tables):
    expected = ["Black Friday", "Clearance", "Flash Sale"]
    return files.type_coverage(t.promotions, expected, "promotion_type")


def sink_partitioned(t: Tables):
    path = scratch_path(t.spark, "sales")
    sinks.write_by_day(t.sales, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), facts.exact_sum("revenue")
    )


def sink_weekly(t: Tables):
    path = scratch_path(t.spark, "inventory")
    sinks.write_by_week(t.inventory_daily.filter(F.weekday("date") == 6), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("year", "week").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("inventory_level").alias("inventory_level"),
    )


def sink_single(t: Tables):
    path = scratch_path(t.spark, "promotions")
    sinks.write_table(t.promotions, path)
    return t.spark.read.parquet(path)


def csv_roundtrip(t: Tables):
    path = scratch_path(t.spark, "daily-csv")
    daily = t.daily
    sinks.write_csv(daily, path)
    return sinks.read_csv(t.spark, path, daily.schema)


def dataset_metadata(t: Tables):
    catalog = files.file_catalog(t.spark, t.dir, TABLES)
    made = sinks.dataset_metadata(t.sales, catalog).drop("generation_date")
    return made.withColumn("file_counts", F.to_json("file_counts"))


def preproc_params(t: Tables):
    path = scratch_path(t.spark, "params")
    train = facts.product_day(t.sales).select("category", "sales", "quantity_sold")
    sinks.save_params(
        path,
        codes=prep.encode_fit(train, ["category"]),
        scaling=prep.scale_fit(train, ["sales", "quantity_sold"]),
    )
    saved = sinks.load_params(t.spark, path, ["codes", "scaling"])
    row = saved["scaling"].select(
        F.round("sales__mean", 3).alias("mean"), F.round("sales__scale", 3).alias("scale")
    )
    return saved["codes"].withColumn("p", row.select(F.struct("*")).scalar()).select(
        "column", "label", "code", "p.mean", "p.scale"
    )


def dq_empty_files(t: Tables):
    """All files with their rows, and whether they are among the empty ones."""
    catalog = catalogued(t)
    empty = quality.empty_files(catalog, catalog.filter(F.col("rows") > 0))
    marked = empty.select("path", F.lit(True).alias("empty"))
    return catalog.join(marked, "path", "left").select(
        "data_type", "rows", F.coalesce("empty", F.lit(False)).alias("empty")
    )


FILE_ROWS = " union all ".join(f"select '{n}' as data_type, count(*) as rows from {n}" for n in TABLES)
CHECKED = ("quantity_sold", "revenue", "balance")


def checked_lines(t: Tables):
    """Sales with the supplier's balance, the one column here that can be negative."""
    return t.store_lines.select(
        "date", F.col("l_quantity").alias("quantity_sold"),
        F.col("l_extendedprice").alias("revenue"), F.col("s_acctbal").alias("balance"),
    )


def dq_negative(t: Tables):
    return quality.negative_values(checked_lines(t), "date", CHECKED)


def dq_summary(t: Tables):
    """Issues per day of sales and per file of suppliers, each with the totals of its check."""
    days = quality.quality_report(checked_lines(t), "date", CHECKED)
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    suppliers = t.raw("supplier").withColumnRenamed("s_acctbal", "balance")
    return days.withColumn("level", F.lit("day")).unionByName(
        quality.quality_report(suppliers, file, ("balance",)).withColumn("level", F.lit("file"))
    )


LINES_SQL = """select cast(l_shipdate as date) as date, min(l_quantity) as quantity_sold,
    min(l_extendedprice) as revenue, min(s_acctbal) as balance, count(*) as n
    from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
    group by 1"""


def dq_value_range(t: Tables):
    limits = {"sales": (0.0, 1e6), "has_promotion": (0.0, 1.0)}
    return quality.value_ranges(t.daily, limits)


def except_keys(t: Tables):
    """The missing keys from the gaps alone."""
    return lookups.missing_dates(t.daily_stage.select("date", "store_id"), ["store_id"]).select("date", "store_id")


def except_keys_spine(t: Tables):
    """The same by the whole spine and an anti-join."""
    daily = t.daily_stage.select("date", "store_id")
    return lookups.except_keys(lookups.spine(daily, ["store_id"]), daily, ["date", "store_id"])


EXCEPT_SQL = """select cast(d as date) as date, store_id
        from (select distinct store_id from {daily}),
        (select unnest(generate_series(min(date), max(date), interval 1 day)) as d from {daily})
        where (cast(d as date), store_id) not in (select (date, store_id) from {daily})"""

QUERIES = {
    "scan_facts": (scan_facts, """select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
        cast(l_shipdate as date) as date from lineitem"""),
    "scan_facts_dated": (scan_facts_dated, sql("""select date, store_id, product_id, revenue
        from {sales} where date between date '1997-01-15' and date '1997-02-10'""")),
    "file_catalog": (file_catalog, " union all ".join(
        f"select '{n}' as data_type, '{n}.parquet' as key, count(*) as rows from {n}" for n in TABLES)),
    "catalog_counts": (catalog_counts, f"""select coalesce(data_type, 'total') as data_type,
        count(*) as files, cast(sum(rows) as bigint) as rows from ({FILE_ROWS})
        group by rollup (data_type)"""),
    "type_coverage": (type_coverage, sql("""select promotion_type,
        promotion_type in (select promotion_type from {promotions}) as found
        from (values ('Black Friday'), ('Clearance'), ('Flash Sale')) e(promotion_type)""")),
    "sink_partitioned": (sink_partitioned, sql("""select cast(year(date) as int) as year,
        cast(month(date) as int) as month, count(*) as n,
        cast(sum(cast(revenue as decimal(18,4))) as double) as revenue
        from {sales} group by 1, 2""")),
    "sink_weekly": (sink_weekly, sql("""select cast(isoyear(date) as int) as year,
        cast(weekofyear(date) as int) as week, count(*) as n,
        cast(sum(inventory_level) as bigint) as inventory_level
        from {inventory_daily} where isodow(date) = 7 group by 1, 2""")),
    "sink_single": (sink_single, sql("select * from {promotions}")),
    "csv_roundtrip": (csv_roundtrip, sql("select * from {daily}")),
    "dataset_metadata": (dataset_metadata, sql("""select
        strftime(min(date), '%Y-%m-%d') as start_date, strftime(max(date), '%Y-%m-%d') as end_date,
        count(distinct store_id) as n_stores, count(distinct product_id) as n_products,
        count(*) as n_rows, 'FILE_COUNTS' as file_counts, cast(TOTAL as bigint) as total_files
        from {sales}""").replace("FILE_COUNTS", "{" + ",".join(f'"{n}":1' for n in sorted(TABLES)) + "}")
        .replace("TOTAL", str(len(TABLES)))),
    "preproc_params": (preproc_params, sql("""select 'category' as "column", category as label,
        cast(dense_rank() over (order by category) - 1 as int) as code, mean, scale
        from (select distinct category from {product_day}),
        (select round(avg(sales), 3) as mean, round(stddev_pop(sales), 3) as scale
         from {product_day})""")),
    "dq_empty_files": (dq_empty_files, f"""select data_type, rows, rows = 0 as empty
        from ({FILE_ROWS})"""),
    "dq_negative": (dq_negative, f"""select date as unit, "column", min_value from (
        unpivot (select date, quantity_sold, revenue, balance from ({LINES_SQL}))
        on quantity_sold, revenue, balance into name "column" value min_value)
        where min_value < 0"""),
    "dq_summary": (dq_summary, f"""with days as ({LINES_SQL}),
        totals as (select count(*) as total_units, cast(sum(n) as bigint) as total_rows,
          cast(sum((quantity_sold < 0)::int + (revenue < 0)::int + (balance < 0)::int) as bigint)
            as total_issues from days),
        files as (select min(s_acctbal) as balance, count(*) as n from supplier)
        select 'day' as level, strftime(i.date, '%Y-%m-%d') as unit, i."column", i.min_value, t.*
        from totals t left join (select * from (unpivot (select date, quantity_sold, revenue, balance
          from days) on quantity_sold, revenue, balance into name "column" value min_value)
          where min_value < 0) i on true
        union all select 'file', case when balance < 0 then 'supplier.parquet' end,
          case when balance < 0 then 'balance' end, case when balance < 0 then balance end,
          1, n, (balance < 0)::int from files"""),
    "dq_value_range": (dq_value_range, sql("""select 'sales' as "column", 0.0::double as min_allowed,
        1e6::double as max_allowed, count(*) filter (not (sales between 0 and 1e6)) as outside,
        count(*) filter (sales is null) as nulls from {daily}
        union all select 'has_promotion', 0.0, 1.0,
        count(*) filter (not (has_promotion between 0 and 1)),
        count(*) filter (has_promotion is null) from {daily}""")),
    "except_keys": (except_keys, sql(EXCEPT_SQL)),
    "except_keys_spine": (except_keys_spine, sql(EXCEPT_SQL)),
}
