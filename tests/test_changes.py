"""Deliveries: discovered files, refreshed days, the streamed daily table."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators.facts import store_day
from tillcast.plans import refresh
from tillcast.sources import discovery, sinks
from tillcast.streaming import daily as stream

SALES = schemas.SALES
DAY = dt.date(2024, 3, 1)


def sale(day, store, product="p", revenue=10.0, category="c"):
    return (None if day is None else DAY + dt.timedelta(days=day), store, product, category, 1, 1, 0.0, revenue, 1.0, revenue - 1.0)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_discovery_sees_new_changed_and_gone_files(spark, tmp_path):
    path, log = f"{tmp_path}/in", f"{tmp_path}/log"
    os.makedirs(path)
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        part = next(f for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/{name}/{part}", f"{path}/{name}.parquet")

    def look(commit=True):
        found = discovery.discover(spark, path, log)
        if commit:
            discovery.commit(found, log)
        return {os.path.basename(r.path): r.change for r in found.collect()}, found

    assert look(commit=False)[0] == {"a.parquet": "new", "b.parquet": "new"}
    assert look()[0] == {"a.parquet": "new", "b.parquet": "new"}  # the first look was not committed
    assert look()[0] == {"a.parquet": "same", "b.parquet": "same"}
    shutil.copy(f"{path}/b.parquet", f"{path}/a.parquet")
    os.remove(f"{path}/b.parquet")
    changes, found = look()
    assert changes == {"a.parquet": "changed", "b.parquet": "gone"}
    assert discovery.scan_changed(spark, found, "id bigint", path).count() == 5
    assert look()[0] == {"a.parquet": "same"}
    assert discovery.scan_changed(spark, look()[1], "id bigint", path).count() == 0
    discovery.NAMED_FILES, kept = 0, discovery.NAMED_FILES
    try:
        assert discovery.scan_changed(spark, found, "id bigint", path).count() == 5
    finally:
        discovery.NAMED_FILES = kept


def test_folder_units(spark):
    paths = ["file:/x/year=2024/month=3/day=9/p.parquet", "file:/x/year=2024/month=3/p.parquet", "file:/x/p.parquet"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    made = frame.select(*[discovery.folder_unit("path", sinks.UNITS[u]).alias(u) for u in ("day", "month")]).collect()
    assert [r.day for r in made] == [20240309, None, None] and [r.month for r in made] == [20240300, 20240300, None]


def test_refresh_and_stream_by_month(spark, tmp_path):
    inputs = refresh.Inputs(f"{tmp_path}/sales", unit="month")
    sales = [sale(d, s) for d in (0, 1, 40, 80) for s in "ab"]
    sinks.write_by_unit(spark.createDataFrame(sales, SALES), inputs.sales, "month")
    assert refresh.refresh_daily(spark, inputs, f"{tmp_path}/daily", f"{tmp_path}/log") == [20240300, 20240400, 20240500]
    shutil.rmtree(f"{inputs.sales}/year=2024/month=4")
    assert refresh.refresh_daily(spark, inputs, f"{tmp_path}/daily", f"{tmp_path}/log") == [20240400]
    assert {r.date for r in refresh.read_daily(spark, f"{tmp_path}/daily").collect()} == {DAY + dt.timedelta(days=d) for d in (0, 1, 80)}
    for number, part in enumerate((sales[:5], sales[5:])):
        stream.deliver_batch(spark.createDataFrame(part, SALES), number, f"{tmp_path}/out", unit="month")
    made = stream.read_delivered(spark, f"{tmp_path}/out")
    assert rows(made, "date", "store_id", "sales") == rows(store_day(spark.createDataFrame(sales, SALES)), "date", "store_id", "sales")


def test_refresh_reads_and_replaces_touched_days_only(spark, tmp_path):
    inputs = refresh.Inputs(f"{tmp_path}/sales", f"{tmp_path}/promotions")
    target, log = f"{tmp_path}/daily", f"{tmp_path}/log"
    sales = spark.createDataFrame([sale(d, s) for d in range(6) for s in "ab"], SALES)
    sinks.write_by_day(sales, inputs.sales)
    promo = spark.createDataFrame([(DAY, "p", "Clearance", 0.2)], schemas.PROMOTIONS)
    sinks.write_by_day(promo, inputs.promotions)
    assert len(refresh.refresh_daily(spark, inputs, target, log)) == 6
    assert refresh.refresh_daily(spark, inputs, target, log) == []
    held = {f: os.stat(f"{target}/{f}").st_mtime_ns for f in _files(target)}

    # an old day is corrected, one loses its files, one gets a promotion, one is new
    sinks.write_by_day(spark.createDataFrame([sale(1, "a", revenue=99.0)], SALES), inputs.sales)
    shutil.rmtree(f"{inputs.sales}/year=2024/month=3/day=4")
    sinks.write_by_day(spark.createDataFrame([(DAY + dt.timedelta(days=4), "p", "Clearance", 0.2)], schemas.PROMOTIONS), inputs.promotions)
    sinks.write_by_day(spark.createDataFrame([sale(9, "c")], SALES), inputs.sales)
    days = refresh.refresh_daily(spark, inputs, target, log)
    assert days == [20240302, 20240304, 20240305, 20240310]
    got = {(r.date.day, r.store_id): (r.sales, r.has_promotion) for r in refresh.read_daily(spark, target).collect()}
    want = {(d, s): (10.0, 1.0 if d in (1, 5) else None) for d in (1, 3, 5, 6) for s in "ab"}
    assert got == want | {(2, "a"): (99.0, None), (10, "c"): (10.0, None)}
    now = {f: os.stat(f"{target}/{f}").st_mtime_ns for f in _files(target)}
    untouched = {f: t for f, t in held.items() if any(f"day={d}/" in f for d in (1, 3, 6))}
    assert len(untouched) >= 3 and all(now[f] == t for f, t in untouched.items())


def _files(root):
    return [os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_refresh_opens_the_folders_of_the_days_only(spark, tmp_path):
    sinks.write_by_day(spark.createDataFrame([sale(d, "a") for d in range(6)], SALES), f"{tmp_path}/sales")
    scan = refresh.scan_units(spark, f"{tmp_path}/sales", SALES, [20240302, 20240305])
    opened = scan.select(F.input_file_name().alias("f")).distinct().collect()
    assert scan.count() == 2 and len(opened) == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "20240302" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    kept, refresh.LISTED_UNITS = refresh.LISTED_UNITS, 1
    try:
        assert rows(refresh.scan_units(spark, f"{tmp_path}/sales", SALES, [20240302, 20240305]), "date") == rows(scan, "date")
    finally:
        refresh.LISTED_UNITS = kept


def test_refresh_refuses_rows_of_other_days(spark, tmp_path):
    sinks.write_by_day(spark.createDataFrame([sale(1, "a")], SALES), f"{tmp_path}/sales")
    sinks.write_table(spark.createDataFrame([sale(3, "a")], SALES), f"{tmp_path}/sales/year=2024/month=3/day=1")
    inputs = refresh.Inputs(f"{tmp_path}/sales")
    for _ in range(2):  # nothing was committed, so the second try sees the same files
        with pytest.raises(ValueError, match="rows of other days"):
            refresh.refresh_daily(spark, inputs, f"{tmp_path}/daily", f"{tmp_path}/log")


def run_stream(spark, root, **options):
    query = stream.deliver_daily(stream.read_sales_stream(spark, f"{root}/in", SALES, **options), f"{root}/out", f"{root}/checkpoint", 3)
    query.awaitTermination(300)
    assert query.exception() is None


def test_stream_delivers_every_row_late_ones_too(spark, tmp_path):
    first = [sale(d, s, p) for d in range(8) for s in "ab" for p in "pq"] + [sale(None, "a"), sale(2, None)]
    second = [sale(0, "a", "late", 7.5), sale(9, "c", revenue=1e12 + 0.25), sale(9, "c", revenue=0.5)]
    for k, part in enumerate((first, second)):
        sinks.write_table(spark.createDataFrame(part, SALES).repartition(4), f"{tmp_path}/in/{k}")
        run_stream(spark, tmp_path, files_per_batch=2)
    run_stream(spark, tmp_path)  # nothing new
    made = stream.read_delivered(spark, f"{tmp_path}/out", 3)
    everything = spark.createDataFrame(first + second, SALES)
    columns = ["date", "store_id", "quantity_sold", "sales", "profit"]
    assert rows(made, *columns) == rows(store_day(everything), *columns)
    assert {r.date for r in made.filter("finished").collect()} == {DAY + dt.timedelta(days=d) for d in range(7)}
    counts = stream.delivery_counts(spark, f"{tmp_path}/out").agg(F.sum("rows"), F.sum("without_key"), F.max("batch")).first()
    assert tuple(counts)[:2] == (len(first) + len(second), 2) and counts[2] >= 2
    assert stream.delivery_counts(spark, f"{tmp_path}/out").agg(F.sum("late")).first()[0] >= 1


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([sale(d, "a") for d in range(3)], SALES)
    for number in (0, 1, 1, 0):
        stream.deliver_batch(batch, number, f"{tmp_path}/out")
    made = stream.read_delivered(spark, f"{tmp_path}/out")
    assert rows(made, "sales", "rows") == [(20.0, 2)] * 3


@pytest.mark.parametrize("scale", [2, 8])
def test_sums_have_no_limit(spark, scale):
    from tillcast.plans.daily import daily_store_sales

    data = spark.createDataFrame([sale(0, "a", str(i), 1e12 + 0.25) for i in range(200)] + [sale(0, "a", "x", -0.75)], SALES)
    assert daily_store_sales(data, scale=scale).first()["sales"] == 2e14 + 50 - 0.75
