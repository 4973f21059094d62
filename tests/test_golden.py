"""Worked examples and edge rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.functions import calendar, demand, intervals
from tillcast.operators import (
    diagnose, evaluate, facts, lookups, prep, quality, registry, report, windows,
)
from tillcast.plans.daily import daily_store_sales


def scored(spark, actual, prediction, model="m"):
    rows = [(model, float(a), float(p)) for a, p in zip(actual, prediction)]
    return spark.createDataFrame(rows, "model string, actual double, prediction double")


def test_error_metrics(spark):
    row = evaluate.regression_metrics(scored(spark, [100, 200, 300], [110, 190, 320])).first()
    assert row["rmse"] == pytest.approx(14.14, abs=0.005)
    assert row["mae"] == pytest.approx(13.33, abs=0.005)
    assert evaluate.regression_metrics(scored(spark, [100, 1000], [110, 1100])).first()[
        "mape"
    ] == pytest.approx(10.0)
    r2 = evaluate.regression_metrics(scored(spark, [100, 200, 300, 400], [110, 190, 310, 390]))
    assert r2.first()["r2"] == pytest.approx(0.992, abs=5e-4)


def test_metrics_of_constant_and_zero_actuals(spark):
    row = evaluate.regression_metrics(scored(spark, [0, 0], [1, 2])).first()
    assert row["r2"] is None and row["mape"] is None and row["mae_x100"] == 150.0


def test_ensemble_weights(spark):
    def weights(rows, **options):
        df = spark.createDataFrame(rows, "model string, r2 double")
        return {r["model"]: r["weight"] for r in
                evaluate.ensemble_weights(df, **options).collect()}

    got = weights([("a", 0.85), ("b", 0.80)])
    assert got["a"] == pytest.approx(0.515, abs=5e-4) and got["b"] == pytest.approx(0.485, abs=5e-4)
    got = weights([("a", 0.9), ("b", -3.0)])
    assert got["b"] == pytest.approx(0.2 / 1.2)
    assert weights([("a", -1.0), ("b", -2.0)]) == {"a": 0.5, "b": 0.5}
    got = weights([("a", 0.9), ("b", 0.6), ("p", 0.0)], optional=("p",))
    assert got["p"] == 0.0 and sum(got.values()) == pytest.approx(1.0)


def test_ensemble_needs_a_positive_weight(spark):
    predictions = spark.createDataFrame(
        [(1, "a", 2.0)], "store_id int, model string, prediction double"
    )
    weights = spark.createDataFrame([("a", 0.0)], "model string, weight double")
    with pytest.raises(Exception, match="positive weight"):
        evaluate.ensemble_predict(predictions, weights, ("store_id",)).collect()


SALES = "date date, store_id int, product_id int, category string, quantity_sold double, " \
        "unit_price double, discount_percent double, revenue double, cost double, profit double"
D1, D2 = dt.date(2025, 1, 1), dt.date(2025, 1, 2)


def sales_rows(spark):
    return spark.createDataFrame(
        [
            (D1, 1, 10, "x", 2.0, 5.0, 0.0, 10.0, 7.0, 3.0),
            (D1, 1, 11, "x", 1.0, 5.0, 0.1, 4.5, 3.5, 1.0),
            (D1, 1, 10, "x", 1.0, 5.0, 0.2, 4.0, 3.5, None),
            (D2, 1, 10, "x", None, 5.0, 0.0, None, None, None),
            (D2, 2, None, "x", 9.0, 5.0, 0.0, 45.0, 1.0, 44.0),  # no product: dropped
            (None, 2, 10, "x", 9.0, 5.0, 0.0, 45.0, 1.0, 44.0),
        ],
        SALES,
    )


def test_daily_store_sales_rules(spark):
    promotions = spark.createDataFrame(
        [(D1, 11, "Flash Sale", 0.1), (D1, 11, "Clearance", 0.3)],
        "date date, product_id int, promotion_type string, discount_percent double",
    )
    traffic = spark.createDataFrame(
        [(D1, 1, 5, True), (D1, 1, 6, False)],
        "date date, store_id int, customer_traffic bigint, is_holiday boolean",
    )
    rows = daily_store_sales(
        sales_rows(spark), promotions, traffic, keep_all=True, promo_ratio=True
    ).orderBy("date").collect()
    assert [(r["date"], r["store_id"]) for r in rows] == [(D1, 1), (D2, 1)]
    first, second = rows
    assert (first["quantity_sold"], first["sales"], first["profit"]) == (4.0, 18.5, 4.0)
    assert first["has_promotion"] == 1.0 and first["promo_ratio"] == 0.5
    assert first["customer_traffic"] == 11 and first["is_holiday"] is True
    assert (second["quantity_sold"], second["sales"]) == (0.0, 0.0)  # a sum of nothing
    assert second["has_promotion"] is None and second["customer_traffic"] is None


def test_daily_without_side_tables(spark):
    row = daily_store_sales(sales_rows(spark)).filter(F.col("date") == F.lit(D1)).first()
    assert row.asDict() == {
        "date": D1, "store_id": 1, "sales": 18.5, "has_promotion": None, "is_holiday": None,
    }


def test_calendar_rules(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2025, 1, 5),)], "date date")
    monday, sunday = df.withColumns(calendar.date_parts()).orderBy("date").collect()
    assert (monday["dayofweek"], monday["weekofyear"], monday["is_weekend"]) == (0, 1, 0)
    assert (sunday["dayofweek"], sunday["weekofyear"], sunday["is_weekend"]) == (6, 1, 1)


def test_weekday_factors(spark):
    week = spark.range(7).select(F.date_add(F.lit("2025-01-06").cast("date"), F.col("id").cast("int")).alias("d"))
    got = [r[0] for r in week.orderBy("d").select(demand.weekday_factor("d")).collect()]
    assert got == [0.9, 0.85, 0.85, 0.9, 1.1, 1.3, 1.2]


def test_event_calendar(spark):
    span = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2025, 12, 20))], "lo date, hi date")
    days = calendar.event_calendar(span)
    black = [r["date"] for r in days.filter("promotion_type = 'Black Friday'").orderBy("date").collect()]
    assert black == [dt.date(2025, 11, 28) + dt.timedelta(days=i) for i in range(5)]
    christmas = [r["date"].day for r in days.filter("promotion_type = 'Christmas Sale'").orderBy("date").collect()]
    assert christmas == [15, 16, 17, 18, 19, 20]  # clipped at the end of the span
    # fourth Thursday when the month begins on one
    span = spark.createDataFrame([(dt.date(2018, 11, 1), dt.date(2018, 11, 30))], "lo date, hi date")
    assert calendar.event_calendar(span).filter("promotion_type = 'Black Friday'").agg(
        F.min("date")).first()[0] == dt.date(2018, 11, 23)


def test_request_dates(spark):
    texts = ["2025-01-31", "2025-02-30", "2025-1-1", "2025/01/01", "", None, "2025-01-01x"]
    df = spark.createDataFrame([(t,) for t in texts], "date string")
    accepted, rejected = calendar.split_requests(df)
    assert [r["request_date"] for r in accepted.collect()] == [dt.date(2025, 1, 31)]
    assert rejected.count() == 6


def test_first_event_and_default(spark):
    days = spark.createDataFrame([(1, D1), (1, D2)], "store_id int, date date")
    events = spark.createDataFrame(
        [(1, D1, "renovation", -0.3), (1, D1, "closure", -1.0)],
        "store_id int, date date, event_type string, impact double",
    )
    got = {r["date"]: r["event_impact"] for r in lookups.lookup_store_event(days, events).collect()}
    assert got == {D1: 0.0, D2: 1.0}
    got = {r["date"]: r["event_impact"] for r in
           lookups.lookup_store_event(days, events, base=2.0).collect()}
    assert got == {D1: 1.0, D2: 1.0}


def test_yearly_events_come_before_flash_sales(spark):
    rows = spark.createDataFrame([(D1, 1), (D2, 1)], "date date, product_id int")
    promotions = spark.createDataFrame(
        [(D1, 1, "Flash Sale", 0.1), (D1, 1, "New Year Sale", 0.2), (D2, 1, "Flash Sale", 0.3),
         (D2, 1, "Clearance", 0.4)],
        "date date, product_id int, promotion_type string, discount_percent double",
    )
    got = {r["date"]: (r["discount_percent"], r["promotion_factor"])
           for r in lookups.lookup_promo_price(rows, promotions).collect()}
    assert got[D1] == (0.2, pytest.approx(1.6)) and got[D2] == (0.4, pytest.approx(2.2))


def test_missing_numbers_do_not_spoil_sums(spark):
    rows = sales_rows(spark).withColumn(
        "revenue", F.when(F.col("product_id") == 11, F.lit(float("nan"))).otherwise(F.col("revenue"))
    )
    assert daily_store_sales(rows).filter(F.col("date") == F.lit(D1)).first()["sales"] == 14.0


def test_encoder_sorts_labels_and_refuses_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "x string")
    codes = prep.encode_fit(train, ["x"])
    assert {r["label"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    later = spark.createDataFrame([("c",), ("z",)], "x string")
    with pytest.raises(Exception, match="unseen label in x: z"):
        prep.encode_apply(later, codes, ["x"]).collect()
    assert {r["x"] for r in prep.encode_apply(later, codes, ["x"], "null").collect()} == {2, None}


def test_scaler_uses_population_deviation(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    params = prep.scale_fit(train, ["x", "k"])
    got = sorted((r["x"], r["k"]) for r in prep.scale_apply(train, params, ["x", "k"]).collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_promotion_needs_compared_key_metrics(spark):
    schema = "model string, metric string, value double"
    production = spark.createDataFrame(
        [("a", "rmse", 10.0), ("a", "mae", 5.0), ("b", "rmse", 10.0), ("b", "mae", 5.0),
         ("c", "r2", 0.5), ("e", "rmse", 0.0)], schema)
    candidate = spark.createDataFrame(
        [("a", "rmse", 9.0), ("a", "mae", 4.0), ("b", "rmse", 9.0), ("b", "mae", 4.99),
         ("c", "r2", 0.9), ("d", "rmse", 1.0), ("e", "rmse", 1.0)], schema)
    compared = registry.compare_metrics(production, candidate)
    got = {
        r["model"]: (r["promoted"], r["reason"]) for r in registry.promote_decision(
            candidate.select("model"), compared, production).collect()
    }
    assert got["a"] == (True, "Improved on 2 out of 2 metrics")
    assert got["b"] == (False, "Performance not improved sufficiently")  # mae below 1 %
    assert got["c"] == (False, "Performance not improved sufficiently")  # no key metric compared
    assert got["d"] == (False, "No production model to compare against")
    assert got["e"][0] is False  # production value 0
    forced = registry.promote_decision(
        candidate.select("model"), compared, production, force_first_deployment=True
    ).filter("model = 'd'").first()
    assert (forced["promoted"], forced["reason"]) == (True, "First deployment")


def test_diagnostics(spark):
    rows = [("train", float(v)) for v in [1, 2, 3, 4, 100]] + [("val", 0.0), ("test", 50.0)]
    df = spark.createDataFrame(rows, "split string, sales double")
    out = {r["split"]: r for r in diagnose.outliers_iqr(df, "sales", ["split"]).collect()}
    assert out["train"]["outliers"] == 1 and out["train"]["max_outlier"] == 100.0
    assert out["val"]["min_outlier"] is None
    shift = {r["split"]: r for r in diagnose.dist_shift(df, "sales").collect()}
    assert shift["test"]["flagged"] is True and shift["train"]["mean_shift"] == 0.0
    constant = df.withColumn("k", F.lit(3.0)).withColumn("double", F.col("sales") * 2)
    corr = {r["feature"]: r for r in
            diagnose.leakage_corr(constant, ["k", "double", "sales"], "sales").collect()}
    assert corr["k"]["corr"] is None and not corr["k"]["flagged"]
    assert corr["double"]["flagged"] and "sales" not in corr


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [(D1, -1.0, 5.0), (D1, 2.0, 1.0), (D2, 1.0, -2.0)],
        "date date, quantity_sold double, revenue double",
    )
    issues = {(r["unit"], r["column"]): r["min_value"] for r in quality.negative_values(df).collect()}
    assert issues == {(D1, "quantity_sold"): -1.0, (D2, "revenue"): -2.0}
    row = quality.quality_summary(df).first()
    assert (row["total_files_checked"], row["total_rows"], row["total_issues"]) == (2, 3, 2)
    out = quality.value_ranges(df, {"revenue": (0.0, 4.0)}).first()
    assert (out["outside"], out["nulls"]) == (2, 0)
    with pytest.raises(ValueError):
        quality.require_columns(df, ["date", "store_id"])


def test_latest_version_falls_back_to_best_run(spark):
    versions = spark.createDataFrame(
        [("m", 2, "r2", "Production"), ("m", 10, "r10", "Production"), ("m", 11, "r11", "Staging"),
         ("n", 1, "s1", "Staging")], "name string, version int, run_id string, stage string")
    runs = spark.createDataFrame(
        [("m", "r2", "rmse", 1.0), ("n", "s1", "rmse", 3.0), ("n", "s2", "rmse", 2.0)],
        "name string, run_id string, metric string, value double")
    got = {r["name"]: (r["version"], r["run_id"]) for r in
           registry.latest_version(versions, runs).collect()}
    assert got == {"m": ("10", "r10"), "n": ("s2", "s2")}
    moved = registry.transition_stage(
        versions, spark.createDataFrame([("m", 11)], "name string, version int"))
    assert {(r["name"], r["version"]): r["stage"] for r in moved.collect()} == {
        ("m", 2): "Archived", ("m", 10): "Archived", ("m", 11): "Production", ("n", 1): "Staging"}


def test_forecast_pick_prefers_and_defaults(spark):
    df = spark.sql(
        "select map('b', 2.0D) as p union all select map('a', 100.0D, 'b', 2.0D) "
        "union all select cast(map() as map<string,double>)"
    ).withColumn("i", F.transform_values("p", lambda k, v: intervals.interval_map(v)))
    got = sorted(
        (r["prediction"], r["lower"], r["upper"]) for r in df.select(
            *[c.alias(n) for n, c in intervals.forecast_pick("p", "i", ["a", "b"]).items()]
        ).collect()
    )
    assert got == [(0.0, 0.0, 0.0), (2.0, 1.61, 2.39), (100.0, 80.4, 119.6)]


def test_normal_quantile(spark):
    got = spark.range(1).select(
        *[report.normal_quantile(F.lit(p)) for p in [0.025, 0.5, 0.975, 0.001]]
    ).first()
    assert list(got) == pytest.approx([-1.959963985, 0.0, 1.959963985, -3.090232306], abs=1e-7)


def test_histogram_counts_every_row(spark):
    rows = spark.createDataFrame([("m", float(x)) for x in range(-10, 11)], "model string, residual double")
    hist = report.error_histogram(rows, bins=5).collect()
    assert sum(r["count"] for r in hist) == 21 and max(r["bin"] for r in hist) == 4
    flat = spark.createDataFrame([("m", 2.0), ("m", 2.0)], "model string, residual double")
    row = report.error_histogram(flat).first()
    assert (row["bin"], row["count"], row["density"]) == (25, 2, 50.0)


def test_top_k_ties_go_by_name(spark):
    df = spark.createDataFrame(
        [("m", "b", 1.0), ("m", "a", 1.0), ("m", "c", 2.0)],
        "model string, feature string, importance double")
    got = windows.top_k(df, 2, ["model"], "importance", "feature").orderBy("rank").collect()
    assert [r["feature"] for r in got] == ["c", "a"]


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "y int")
    assert sorted(facts.union_facts(a, b).collect(), key=str) == sorted(
        [(1, 2), (None, 3)], key=str)
