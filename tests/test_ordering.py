"""Order-dependent operators against brute force, with a hot key that holds a third of the rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillcast.operators import fill, ordering, quantiles, windows
from tillcast.operators.split import split_chrono


@pytest.fixture(scope="module")
def skewed():
    """Unique (date, store) keys; one date and one store hold a third of the rows each."""
    rng = random.Random(7)
    keys = set()
    while len(keys) < 3000:
        kind = rng.randrange(3)
        day = 5 if kind == 0 else rng.randrange(400)
        store = 3 if kind == 1 and len({k for k in keys if k[1] == 3}) < 390 else rng.randrange(1200)
        keys.add((day, store))
    rows = [(d, s, float(rng.randrange(1, 500))) for d, s in sorted(keys)]
    frame = pd.DataFrame(rows, columns=["day", "store_id", "sales"])
    frame["date"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["day"], unit="D")).dt.date
    return frame[["date", "store_id", "sales"]].sort_values(["date", "store_id"], ignore_index=True)


def test_position_and_range(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = ordering.with_position(df, ["date", "store_id"], range_rows=200).toPandas()
    got = got.sort_values("position", ignore_index=True)
    assert list(got["position"]) == list(range(len(skewed)))
    assert (got["store_id"] == skewed["store_id"]).all()


@pytest.mark.parametrize("range_rows", [1_000_000, 10])
def test_split_matches_positions(spark, skewed, range_rows, monkeypatch):
    monkeypatch.setattr(ordering.keys_at, "__defaults__", ("total", range_rows))
    df = spark.createDataFrame(skewed).repartition(5)
    got = split_chrono(df).toPandas().sort_values(["date", "store_id"], ignore_index=True)
    n = len(skewed)
    train, val = int(n * 0.7), int(n * 0.15)
    expected = ["train"] * train + ["val"] * val + ["test"] * (n - train - val)
    assert list(got["split"]) == expected


def test_ranges_grow_with_the_rows(spark, skewed):
    df = spark.createDataFrame(skewed)
    for rows in (100, 1000):
        made = ordering.with_range(df, ["date", "store_id"], "r", range_rows=rows)
        sizes = [r["count"] for r in made.groupBy("r").count().collect()]
        assert sum(sizes) == len(skewed) and len(sizes) >= len(skewed) // rows - 1
    import inspect

    assert "offset(" not in inspect.getsource(ordering)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_split_of_few_rows(spark, n):
    days = pd.date_range("2024-01-01", periods=n).date
    df = spark.createDataFrame(pd.DataFrame({"date": days, "store_id": 1}))
    got = split_chrono(df).toPandas().sort_values("date")
    train, val = int(n * 0.7), int(n * 0.15)
    assert list(got["split"]) == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


@pytest.mark.parametrize("accuracy, range_rows", [(100, 50), (10_000, 1_000_000)])
def test_quantiles_of_hot_group_and_hot_value(spark, accuracy, range_rows):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "g": ["hot"] * 4000 + ["a"] * 5 + ["b"] * 2 + ["c"],
            # a third of the hot group is one value
            "v": np.concatenate([np.zeros(1400), rng.normal(size=2600), rng.normal(size=8)]),
        }
    )
    frame.loc[10, "v"] = None
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, "v", probabilities, ["g"], accuracy, range_rows).toPandas()
    for row in got.itertuples():
        expected = frame[frame["g"] == row.g]["v"].quantile(row.probability)
        assert row.quantile == pytest.approx(expected, abs=1e-12)
    assert len(got) == 4 * len(probabilities)


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    got = {r["probability"]: r["quantile"] for r in
           quantiles.exact_quantiles(df, "v", [0.1, 0.5], []).collect()}
    assert got == {0.1: 10.0, 0.5: 50.0}


def test_blocks_equal_plain_windows(spark, skewed):
    df = spark.createDataFrame(skewed)
    plain = windows.sequence_features(df, group_cols=["store_id"])
    cut = windows.sequence_features(df, group_cols=["store_id"], block_rows=64)
    key = ["store_id", "date"]
    a = plain.toPandas().sort_values(key, ignore_index=True)
    b = cut.toPandas().sort_values(key, ignore_index=True)[a.columns]
    pd.testing.assert_frame_equal(a, b)


def test_features_match_pandas(spark, skewed):
    made = windows.sequence_features(spark.createDataFrame(skewed), group_cols=["store_id"])
    got = made.toPandas().sort_values(["store_id", "date"], ignore_index=True)
    want = skewed.sort_values(["store_id", "date"], ignore_index=True)
    group = want.groupby("store_id")["sales"]
    for k in [1, 7, 30]:
        pd.testing.assert_series_equal(got[f"sales_lag_{k}"], group.shift(k), check_names=False)
    for w in [3, 14, 30]:
        for f in ["mean", "std", "min", "max", "median"]:
            expected = group.transform(lambda x: x.shift(1).rolling(w, min_periods=1).agg(f))
            pd.testing.assert_series_equal(
                got[f"sales_rolling_{w}_{f}"], expected, check_names=False, rtol=1e-9, atol=1e-9
            )


def test_halo_deeper_than_block_is_refused(spark, skewed):
    with pytest.raises(ValueError):
        windows.lag_features(spark.createDataFrame(skewed), lags=[30], block_rows=20)


@pytest.mark.parametrize("scope", ["group", "global"])
def test_fill_matches_pandas(spark, skewed, scope):
    frame = skewed.copy()
    frame["x_lag_1"] = frame["sales"].where(frame["sales"] % 7 == 0)
    df = spark.createDataFrame(frame).withColumn("x_lag_1", F.when(~F.isnan("x_lag_1"), F.col("x_lag_1")))
    got = fill.fill_sequences(df, ["x_lag_1"], scope=scope).toPandas()
    got = got.sort_values(["store_id", "date"], ignore_index=True)
    want = frame.sort_values(["store_id", "date"], ignore_index=True)
    if scope == "global":
        expected = want["x_lag_1"].ffill().bfill()
    else:
        expected = want.groupby("store_id")["x_lag_1"].transform(lambda x: x.ffill().bfill())
    pd.testing.assert_series_equal(got["x_lag_1"], expected, check_names=False)


def test_fill_of_a_column_without_values(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", None), (1, "2024-01-02", None)], "store_id int, date string, a_lag_1 double"
    )
    for scope in ["group", "global"]:
        assert fill.fill_sequences(df, scope=scope).filter("a_lag_1 is not null").count() == 0


def test_only_sequence_features_are_filled(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", 1, 2.0), (1, "2024-01-02", None, None)],
        "store_id int, date string, promo_flag int, y_rolling_3_mean double",
    )
    assert fill.sequence_columns(df) == ["y_rolling_3_mean"]
    assert fill.fill_sequences(df).filter("promo_flag is null").count() == 1


def test_quantiles_outside_a_bracket_are_found(spark, monkeypatch):
    """A first attempt with no margin at all misses; the wider ones do not."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plain = quantiles._bracketed
    seen = []

    def narrow(data, probabilities, group_cols, accuracy, margin, range_rows):
        seen.append(margin)
        made = plain(data, probabilities, group_cols, accuracy, margin, range_rows)
        miss = (F.col("probability") == 0.5) & F.lit(len(seen) == 1)
        return made.withColumn("quantile", F.when(~miss, F.col("quantile")))

    monkeypatch.setattr(quantiles, "_bracketed", narrow)
    got = {(r["g"], r["probability"]): r["quantile"] for r in
           quantiles.exact_quantiles(df, "v", [0.25, 0.5], ["g"]).collect()}
    want = {(g, p): float(np.quantile(np.arange(g, 1000, 3), p)) for g in range(3) for p in (0.25, 0.5)}
    assert got == want and len(seen) == 2


@pytest.mark.parametrize("range_rows", [10, 1_000_000])
def test_stored_sketches_give_the_same_quantiles(spark, range_rows):
    draw = random.Random(6)
    rows = [(g, f"d{i % 9}", None if draw.random() < 0.05 else float(round(draw.gauss(0, 9), draw.choice([0, 6])))) for g in "ab" for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, day string, v double").cache()
    points = [0.01, 0.25, 0.5, 0.75, 0.999]
    stored = quantiles.sketches(frame, "v", ["g"], "day")
    assert stored.count() == 18
    key = lambda r: (r.g, r.probability)
    plain = sorted(quantiles.exact_quantiles(frame, "v", points, ["g"], range_rows=range_rows).collect(), key=key)
    merged = sorted(quantiles.exact_quantiles(frame, "v", points, ["g"], range_rows=range_rows, stored=stored).collect(), key=key)
    assert merged == plain and len(plain) == 10
    for r in plain:
        values = sorted(v for g, _, v in rows if g == r.g and v is not None)
        place = r.probability * (len(values) - 1)
        low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
        assert r.quantile == pytest.approx(low + (high - low) * (place - int(place)))
