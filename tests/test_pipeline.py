"""Files, plans, training, batch forecasts and the arriving-files stream, end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.views import Tables
from tillcast import schemas
from tillcast.functions import calendar
from tillcast.operators import evaluate, windows
from tillcast.plans import batch, training
from tillcast.plans.features import all_features
from tillcast.sources import files, sinks
from tillcast.streaming import daily as stream


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def dataset(tables, tmp_path_factory):
    """Dated folders of Parquet files per data type."""
    root = str(tmp_path_factory.mktemp("data"))
    june = F.col("date").between(dt.date(1998, 6, 1), dt.date(1998, 7, 15))
    sales = tables.sales.filter(june).select(
        "date", F.col("store_id").cast("string"), F.col("product_id").cast("string"), "category",
        F.col("quantity_sold").cast("bigint"), F.col("unit_price").cast("bigint"),
        "discount_percent", "revenue", "cost", "profit",
    )
    sinks.write_by_day(sales, f"{root}/sales")
    sinks.write_table(
        tables.promotions.filter(june).withColumn("product_id", F.col("product_id").cast("string")),
        f"{root}/promotions",
    )
    return root, sales


def test_scan_reads_back_what_was_written(spark, dataset):
    root, sales = dataset
    walked = files.scan_facts(spark, f"{root}/sales", schemas.SALES)
    assert walked.columns == sales.columns
    assert walked.exceptAll(sales).count() == 0 and walked.count() == sales.count()


def test_scan_prunes_folders(spark, dataset):
    root, sales = dataset
    scan = files.scan_facts(
        spark, f"{root}/sales", schemas.SALES, "1998-07-03", "1998-07-09", partitioned=True
    )
    want = sales.filter(F.col("date").between(dt.date(1998, 7, 3), dt.date(1998, 7, 9)))
    assert scan.count() == want.count() > 0
    assert "month" not in scan.columns
    plan = scan._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "year" in partition_filters and "month" in partition_filters and "day" in partition_filters


@pytest.mark.parametrize("unit, date_as", [("us", "timestamp"), ("ns", "nanos")])
def test_scan_of_timestamp_dates(spark, tmp_path, unit, date_as):
    import pyarrow as pa
    import pyarrow.parquet as pq

    days = [dt.datetime(1969, 12, 31), dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2, 13)]
    table = pa.table({
        "date": pa.array(days, pa.timestamp(unit)), "store_id": ["s"] * 3, "impact": [1.0, 2.0, 3.0],
    })
    path = f"{tmp_path}/store_events/year=2025/month=01/day=01"
    import os

    os.makedirs(path)
    pq.write_table(table, f"{path}/events.parquet", version="2.6")
    root = f"{tmp_path}/store_events"
    scan = files.scan_facts(spark, root, schemas.STORE_EVENTS, date_as=date_as)
    assert [r["date"] for r in scan.orderBy("date").collect()] == [d.date() for d in days]
    last = files.scan_facts(
        spark, root, schemas.STORE_EVENTS, "2025-01-02", "2025-01-02", date_as=date_as
    )
    assert [r["impact"] for r in last.collect()] == [3.0]
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan.split("PushedFilters")[1]


def test_catalog(spark, dataset):
    root, sales = dataset
    catalog = files.file_catalog(spark, root, endpoint="http://store:9000", bucket="data")
    row = catalog.filter("data_type = 'sales'").orderBy("key").first()
    assert row["key"].startswith("sales/year=1998/month=6/day=")
    assert row["url"] == f"http://store:9000/data/{row['key']}"
    assert row["s3_path"] == f"s3://data/{row['key']}"
    counts = {r["data_type"]: r["files"] for r in files.catalog_counts(catalog).collect()}
    assert counts["total"] == counts["sales"] + counts["promotions"]
    missing = files.missing_types(catalog, ["sales", "promotions", "inventory"])
    assert [r[0] for r in missing.collect()] == ["inventory"]
    meta = sinks.dataset_metadata(sales, catalog).first()
    assert meta["file_counts"]["sales"] == counts["sales"] and meta["total_files"] == counts["total"]


def test_empty_files_are_found(spark, dataset, tmp_path):
    from tillcast.operators.quality import empty_files

    _, sales = dataset
    path = f"{tmp_path}/sales"
    sinks.write_table(sales.limit(5).coalesce(1), path)
    sinks.write_table(sales.limit(0).coalesce(1), path, mode="append")
    catalog = files.file_catalog(spark, path, ["part"])
    empty = empty_files(catalog, files.files_with_rows(spark, path))
    assert catalog.count() == 2 and empty.count() == 1


def test_negative_values_per_file(spark, dataset):
    from tillcast.operators.quality import negative_values, quality_summary

    root, sales = dataset
    sinks.write_by_day(sales.withColumn("profit", -F.col("profit")), f"{root}/broken")
    broken = files.scan_facts(spark, f"{root}/broken", schemas.SALES)
    path = F.col("_metadata.file_path")
    issues = negative_values(broken, path, ("revenue", "profit"))
    days = sales.select("date").distinct().count()
    assert issues.count() == days > 0 and issues.first()["unit"].endswith(".parquet")
    scan = files.scan_facts(spark, f"{root}/sales", schemas.SALES)
    summary = quality_summary(scan, path, ("quantity_sold", "revenue")).first()
    assert summary["total_files_checked"] == sales.select("date").distinct().count()
    assert summary["total_issues"] == 0 and summary["total_rows"] == sales.count()


def test_weekly_snapshot_uses_iso_year(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 12, 30), 1), (dt.date(2025, 1, 5), 2)], "date date, x int")
    sinks.write_by_week(df, f"{tmp_path}/inventory")
    rows = spark.read.parquet(f"{tmp_path}/inventory").select("year", "week").distinct().collect()
    assert [tuple(r) for r in rows] == [(2025, 1)]


def test_csv_rejects_malformed_rows(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,x\nnope,y\n")
    with pytest.raises(Exception):
        sinks.read_csv(spark, str(path), "a int, b string").collect()


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_need_one_shuffle(spark, tables):
    daily = tables.daily_stage
    made = all_features(daily, spark.createDataFrame([(dt.date(1998, 1, 1),)], "date date"))
    plan = exchanges(made).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(store_id") == 1
    assert plan.count("Sort [store_id") == 1
    assert "SinglePartition" not in plan


def test_flagship_shuffles_by_key_only(tables):
    plan = exchanges(tables.daily).split("== Initial Plan ==")[0]
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_no_query_multiplies_rows(spark, sf_dir):
    """Cheap guard over registered joins: no cross or nested-loop join in any lazy plan."""
    import __spark_entry__ as registered

    for name in ["daily_store_sales", "spine_cross", "except_keys",
                 "request_history", "report_qq", "outliers_iqr", "promote_decision"]:
        df = registered.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_latest_rows_are_cut_before_the_shuffle(tables):
    plan = exchanges(windows.latest_per_group(tables.daily_stage, 30, ["store_id"]))
    assert "WindowGroupLimit" in plan


def test_interaction_features_and_order(spark, tables):
    made = all_features(
        tables.daily_stage.withColumn("region", F.lit("r")), tables.holidays,
        categorical_cols=["store_id", "region"], windows_=[3],
    )
    assert "store_id_region_interaction" in made.columns
    row = made.first()
    assert row["store_id_region_interaction"] == f"{row['store_id']}_r"
    assert [c for c in made.columns if "rolling" in c] == [
        f"sales_rolling_3_{f}" for f in ["mean", "std", "min", "max", "median"]
    ]


@pytest.fixture(scope="module")
def trained(spark, tables):
    # a text store key exercises the encoder
    daily = tables.daily_stage.withColumn("store_id", F.format_string("store_%03d", "store_id"))
    features = all_features(daily, tables.holidays)
    model = training.train_pipeline(
        features, boosted_params={"maxIter": 5, "maxDepth": 3},
        forest_params={"numTrees": 5, "maxDepth": 4}, trials=0,
    )
    return daily, model


def test_training(trained):
    daily, model = trained
    metrics = {r["model"]: r for r in model.metrics.collect()}
    assert set(metrics) == {"boosted", "forest", "ensemble"}
    n = daily.count()
    assert {r["n"] for r in metrics.values()} == {n - int(n * 0.7) - int(n * 0.15)}
    weights = [r["weight"] for r in model.weights.collect()]
    assert sum(weights) == pytest.approx(1.0) and min(weights) > 0.1
    assert model.prepared.categorical == ["store_id"]
    per_model = model.importances.groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert [r["s"] for r in per_model] == pytest.approx([1.0, 1.0])
    checks = {r["check"] for r in model.diagnosis.select("check").distinct().collect()}
    assert checks == {
        "outliers", "outlier_lower_bound", "outlier_upper_bound", "distribution_shift", "leakage",
        "zero_target", "sample_size", "feature_count", "extreme_low", "extreme_high", "pred_mean",
        "pred_std", "residual_mean", "residual_std", "mape",
    }


def test_split_filters_skip_folders(trained):
    _, model = trained
    plan = model.prepared.rows.filter("split = 'val'")._jdf.queryExecution().executedPlan()
    assert "(split" in plan.toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_search_draws_inside_the_ranges_and_repeats():
    first = training.draw_trials(training.BOOSTED_SEARCH, 30)
    assert first == training.draw_trials(training.BOOSTED_SEARCH, 30)
    for trial in first:
        for name, (low, high) in training.BOOSTED_SEARCH.items():
            assert low <= trial[name] <= high and isinstance(trial[name], type(low))


def test_batch_forecast(spark, tables, trained):
    daily, model = trained
    one, two = [r[0] for r in daily.select("store_id").distinct().orderBy("store_id").take(2)]
    requests = spark.createDataFrame(
        [(one, "2001-12-01", {"has_promotion": "1"}), (one, "2001-12-01", None),
         (one, "2001-12-01", None), (two, "1996-05-05", None), (two, "not a date", None)],
        schemas.REQUESTS,
    )
    accepted, rejected = calendar.split_requests(requests)
    assert rejected.count() == 1
    made = batch.batch_predict(
        accepted, daily, tables.holidays, model.prepared, model.models, model.weights
    )
    rows = made.collect()
    assert len(rows) == 4 * 3  # every accepted request, duplicates too, and three models
    for r in rows:
        assert r["lower_95"] <= r["lower_80"] <= r["prediction"] <= r["upper_80"] <= r["upper_95"]
    shaped = batch.responses(made)
    assert shaped.count() == 3
    answer = shaped.filter(F.col("store_id") == two).first()
    assert set(answer["predictions"]) == {"boosted", "forest", "ensemble"}
    assert set(answer["intervals"]["ensemble"]) == {"confidence_0.8", "confidence_0.95"}


def test_saved_models_answer_the_same(spark, tables, trained, tmp_path):
    daily, model = trained
    training.save_serving(model, f"{tmp_path}/v1")
    loaded = training.load_serving(spark, f"{tmp_path}/v1")
    assert loaded.prepared.features == model.prepared.features
    points = daily.groupBy("store_id").agg(F.max("date").alias("request_date"))
    answers = [
        batch.batch_predict(points, daily, tables.holidays, m.prepared, m.models, m.weights)
        for m in (model, loaded)
    ]
    assert answers[0].exceptAll(answers[1]).count() == 0 < answers[0].count()


def test_request_features_equal_training_features(spark, tables):
    """A request for a day that has sales gets the features of that day's row."""
    daily = tables.daily_stage
    made = all_features(daily, tables.holidays)
    # later rows have a full history, so nothing was filled
    full = made.filter("date > '1999-06-01'")
    points = full.select("store_id", F.col("date").alias("request_date"), "has_promotion")
    got = batch.request_features(points, daily, tables.holidays)
    names = [c for c in full.columns if "lag" in c or "rolling" in c or c.endswith(("_sin", "_cos"))]
    joined = full.alias("a").join(
        got.alias("b"),
        (F.col("a.store_id") == F.col("b.store_id")) & (F.col("a.date") == F.col("b.request_date")),
    )
    worst = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.greatest(*[
            F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / (1 + F.abs(F.col(f"a.{c}"))) for c in names
        ])).alias("gap"),
    ).first()
    assert worst["n"] == full.count() > 100 and worst["gap"] < 1e-9


def test_lags_never_use_later_rows(tables):
    made = windows.lag_features(
        tables.daily_stage.withColumn("sales", F.unix_date("date").cast("double")),
        group_cols=["store_id"],
    )
    assert made.filter("sales_lag_1 >= sales or sales_lag_30 > sales - 30").count() == 0


def test_sample_is_repeatable_and_complete_below_its_size(tables):
    daily = tables.daily_stage
    a = evaluate.sample_seeded(daily.repartition(7), ["date", "store_id"], 50)
    b = evaluate.sample_seeded(daily, ["date", "store_id"], 50)
    assert a.exceptAll(b).count() == 0 and a.count() == 50
    assert evaluate.sample_seeded(daily.limit(20), ["date", "store_id"], 50).count() == 20


def test_stream_equals_batch_for_final_days(spark, dataset, tmp_path):
    root, sales = dataset
    rows = stream.stream_store_day(
        stream.read_sales_stream(spark, f"{root}/sales", schemas.SALES), "3 days"
    )
    query = stream.write_stream(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").withColumn("date", F.to_date("day"))
    last = sales.agg(F.date_sub(F.max("date"), 4)).first()[0]
    from tillcast.operators.facts import store_day

    want = store_day(sales).filter(F.col("date") <= F.lit(last)).select("date", "store_id", "sales")
    have = got.filter(F.col("date") <= F.lit(last)).select("date", "store_id", "sales")
    assert want.exceptAll(have).count() == 0 and have.exceptAll(want).count() == 0 < want.count()


def test_registered_names():
    import __spark_entry__ as registered

    names = registered.queries()
    assert set(registered.oracle_sql()) <= set(names)
    assert len(names) >= 100


def test_boosting_uses_all_rounds_and_patience_settles_on_the_best(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(1200).select(
        (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"),
        F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"),
    ).withColumn("label", F.sin(F.col("a") / 9) * 10 + F.col("b") + F.when(F.col("split") == "train", F.rand(1) * 20).otherwise(10.0))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    full = training.train_gbt(rows, maxIter=25, maxDepth=3, stepSize=0.4)
    assert full.getNumTrees == 25
    losses = full.evaluateEachIteration(rows.filter("split = 'val'"), "squared")
    kept = training.train_gbt(rows, patience=4, maxIter=25, maxDepth=3, stepSize=0.4)
    assert kept.getNumTrees == training.best_round(losses, 4) > 1
    assert training.best_round([5, 4, 3, 3.5, 3.4, 3.3, 1], 3) == 3
    assert training.best_round([5, 4, 3, 3.5, 3.4, 3.3, 1], 9) == 7 and training.best_round([1.0], 1) == 1


@pytest.fixture(scope="module")
def custom(spark, tables):
    """A model with its own lags and windows and a feature that only requests can bring."""
    daily = tables.daily_stage.withColumn("store_id", F.format_string("store_%03d", "store_id")).withColumn(
        "footfall", F.dayofmonth("date").cast("double")
    )
    spec = training.FeatureSpec(lags=[1, 60], windows=[5], functions=["mean"])
    model = training.train_pipeline(
        spec.build(daily, tables.holidays), boosted_params={"maxIter": 3, "maxDepth": 3},
        forest_params={"numTrees": 3, "maxDepth": 3}, trials=0, spec=spec,
    )
    return daily, model


def test_serving_makes_the_features_of_training(spark, tables, custom, tmp_path):
    daily, model = custom
    assert {"sales_lag_60", "footfall", "sales_rolling_5_mean"} <= set(model.prepared.features)
    assert batch.given_features(model.prepared) == ["has_promotion", "footfall"]
    store = daily.first()["store_id"]
    requests = spark.createDataFrame(
        [(store, "2001-12-01", {"footfall": "30", "weather": "wet"}), (store, "2001-12-01", {"footfall": "1"}),
         (store, "2001-12-02", {"footfall": "many"}), ("store_999", "2001-12-01", None)], schemas.REQUESTS,
    )
    accepted, _ = calendar.split_requests(requests)
    training.save_serving(model, f"{tmp_path}/v2")
    loaded = training.load_serving(spark, f"{tmp_path}/v2")
    assert loaded.prepared.spec == model.prepared.spec
    rows = batch.batch_predict(accepted, daily, tables.holidays, loaded.prepared, loaded.models, loaded.weights).collect()
    assert len(rows) == 3 * 3 and {r["store_id"] for r in rows} == {store}
    assert {r["footfall"] for r in rows} == {30.0, 1.0, None}
    _, rejected = batch.split_known(batch.with_given(accepted, model.prepared), model.prepared)
    assert [r["reason"] for r in rejected.collect()] == ["unseen label in store_id: store_999"]
    unused = {(r["feature"], r["reason"]) for r in batch.unusable_features(accepted, model.prepared).collect()}
    assert unused == {("weather", "not a trained feature"), ("footfall", "not a number")}


def test_measures_do_not_travel_to_the_promotion_keys(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.daily._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "product_id" in x]
    assert lines
    import re

    # below an exchange by product, rows hold keys only
    for match in re.finditer(r"Exchange hashpartitioning\(date[^\n]*product_id[^\n]*\n[^\n]*(?:Project|HashAggregate)([^\n]*)", plan):
        assert "revenue" not in match[1] and "quantity" not in match[1]


def test_amounts_and_means_keep_their_decimals(spark):
    from tillcast.operators.facts import product_day

    rows = [(dt.date(2024, 1, 1), 1, 1, "c", 1.0, 0.00004, 0.0, 0.0, d, 1.0) for d in (0.123456789, 0.234567891, 0.1790123)]
    made = product_day(spark.createDataFrame(
        rows, "date date, store_id int, product_id int, category string, quantity_sold double, revenue double, cost double, profit double, discount_percent double, unit_price double"
    )).first()
    assert made["sales"] == 0.00012 and made["discount_percent"] == pytest.approx(sum(r[8] for r in rows) / 3, abs=1e-15)


def test_stages_are_deleted(spark, tmp_path):
    from tillcast import session

    path = session.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    folder = path.rsplit("/", 1)[0]
    import os

    assert os.path.isdir(folder.removeprefix("file://").removeprefix("file:"))
    assert session._is_temporary(spark, "/tmp/x") and not session._is_temporary(spark, "/data/x")
