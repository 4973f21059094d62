"""One regression per group, lasting events, gaps, versions as of a date."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import fleet, lookups, registry

DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("ridge", [0.0, 0.5])
def test_fit_against_numpy(spark, ridge):
    draw = np.random.default_rng(3)
    data, want = [], {}
    for g, n in (("hot", 400), ("small", 6), ("one", 1), ("flat", 30), ("twin", 40)):
        x = draw.normal(1e4, 50, (n, 3))
        if g == "flat":
            x[:, 1] = 5.0
        if g == "twin":
            x[:, 2] = 2 * x[:, 0] + 1
        y = x @ [2.0, -1.0, 0.5] + draw.normal(0, 1, n)
        data += [(g, *map(float, row), float(v)) for row, v in zip(x, y)] + [(g, None, 1.0, 1.0, 1.0), (g, float("nan"), 1.0, 1.0, 1.0)]
        centred = x - x.mean(0)
        use = [j for j in range(3) if not (n == 1 or (g, j) in (("flat", 1), ("twin", 2)))]
        b = np.zeros(3)
        if use:
            c = centred[:, use].T @ centred[:, use] / n
            b[use] = np.linalg.solve(c + ridge * np.diag(np.diag(c)), centred[:, use].T @ (y - y.mean()) / n)
        if not (ridge and g == "twin"):  # with a penalty a copied feature is no longer superfluous
            want[g] = (n, y.mean() - b @ x.mean(0), *b)
    frame = spark.createDataFrame(data, "g string, a double, b double, c double, y double")
    made = {r.g: r for r in fleet.fit(frame, ["g"], ["a", "b", "c"], "y", ridge).collect()}
    assert set(made) == {"hot", "small", "one", "flat", "twin"}
    for g, (n, *values) in want.items():
        row = made[g]
        assert row.n == n
        assert [row.intercept, row.coef_a, row.coef_b, row.coef_c] == pytest.approx(values, rel=1e-5, abs=1e-5), g
    assert made["one"].r2 is None and (ridge or made["hot"].r2 > 0.99)


def test_predict_keeps_every_row(spark):
    models = spark.createDataFrame([("a", 1.0, 2.0)], "g string, intercept double, coef_x double")
    data = spark.createDataFrame([("a", 3.0), ("a", None), ("z", 1.0)], "g string, x double")
    found = sorted(((r.g, r.x, r.prediction) for r in fleet.predict(data, models, ["g"], ["x"]).collect()), key=str)
    assert found == [("a", 3.0, 7.0), ("a", None, None), ("z", 1.0, None)]


def test_interval_join_against_all_pairs(spark):
    draw = random.Random(1)
    points = [(draw.choice("abc"), draw.choice([None, *range(300)])) for _ in range(300)]
    spans = [(draw.choice("abc"), s, None if draw.random() < 0.2 else s + draw.randint(-3, 90), draw.choice("xy"), draw.random()) for s in (draw.randint(-60, 320) for _ in range(120))]
    spans.append(("a", None, 5, "x", 0.5))
    frame = spark.createDataFrame([(s, day(d)) for s, d in points], "store_id string, date date").cache()
    events = spark.createDataFrame([(s, day(a), day(b), k, i) for s, a, b, k, i in spans], "store_id string, start date, end date, event_type string, impact double")
    want = sorted((s, d, a, i) for s, d in points for t, a, b, _, i in spans if s == t and d is not None and a is not None and a <= d and (b is None or d <= b))
    for width in (1, 32, 1000):
        joined = lookups.interval_join(frame, events, ["store_id"], bucket_days=width)
        found = sorted((r.store_id, (r.date - DAY).days, (r.start - DAY).days, r.impact) for r in joined.collect())
        assert found == want
    made = lookups.lookup_store_interval(frame, events)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    best = {}
    for s, d in points:
        held = [(-a, k, i) for t, a, b, k, i in spans if s == t and d is not None and a is not None and a <= d and (b is None or d <= b)]
        best[s, d] = 1.0 + min(held)[2] if held else 1.0
    assert made.count() == len(points)
    assert {(r.store_id, None if r.date is None else (r.date - DAY).days): r.event_impact for r in made.collect()} == best


def test_missing_dates_are_made_from_the_gaps(spark):
    held = {"a": [0, 1, 1, 5, 9], "b": [3], "c": [20], "d": [None, 4]}
    frame = spark.createDataFrame([(k, day(d)) for k, days in held.items() for d in days], "k string, date date").cache()
    for start, end in ((None, None), (2, 7), (0, 3)):
        lo, hi = (0 if start is None else start), (20 if end is None else end)
        want = sorted((k, d) for k, days in held.items() for d in range(lo, hi + 1) if d not in days)
        made = lookups.missing_dates(frame, ["k"], *(None if x is None else str(day(x)) for x in (start, end)))
        assert sorted((r.k, (r.date - DAY).days) for r in made.collect()) == want
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_versions_as_of(spark):
    changes = [("m", "1", 0, "Production"), ("m", "2", 5, "Staging"), ("m", "2", 10, "Production"), ("m", "2", 14, "Archived"),
               ("m", "1", 20, "Production"), ("m", "3", 20, "Production"), ("n", "1", 3, "Staging"), ("m", "3", 30, "Staging"), ("m", "3", 30, "Production")]
    frame = spark.createDataFrame([(n, v, f"run{v}", s, day(d)) for n, v, d, s in changes], "name string, version string, run_id string, stage string, date date")
    points = spark.createDataFrame([(n, day(d)) for n in "mn" for d in range(-1, 40)], "name string, date date").cache()
    found = {(r.name, (r.date - DAY).days): r.version for r in registry.version_as_of(points, frame).collect()}
    want = {("m", d): 1 if 0 <= d < 10 else 2 if 10 <= d < 14 else 3 if d >= 20 else None for d in range(-1, 40)}
    assert found == want | {("n", d): None for d in range(-1, 40)}


def test_weights_and_best_models_come_from_the_fleet(spark):
    rows = [(s, d, "train" if d < 20 else "val" if d < 30 else "test", float(d % 7), float(d % 5), 3.0 * (d % 7) + s) for s in (1, 2) for d in range(40)]
    frame = spark.createDataFrame(rows, "store_id int, day int, split string, a double, b double, sales double")
    models, predictions = fleet.train_fleet(frame, ["store_id"], {"a": ["a"], "b": ["b"]}, "sales", ["store_id", "day"])
    assert models.count() == 4 and predictions.count() == 2 * 2 * 20
    from tillcast.operators import evaluate

    metrics = evaluate.regression_metrics(predictions.filter("split = 'val'"), ["store_id", "model"])
    weights = {(r.store_id, r.model): r.weight for r in evaluate.ensemble_weights(metrics, ["store_id"]).collect()}
    assert all(weights[s, "a"] > weights[s, "b"] for s in (1, 2))
    assert {r.best_model for r in registry.best_model(metrics, ["store_id"]).collect()} == {"a"}
    assert predictions.filter("model = 'a'").filter(F.abs(F.col("actual") - F.col("prediction")) > 1e-6).count() == 0
