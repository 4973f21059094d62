"""Forecast many requests in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast import config
from tillcast.functions import calendar, intervals
from tillcast.operators import lookups, prep
from tillcast.plans.training import FeatureSpec, Prepared, predict_long, predict_wide, weight_map

REQUEST = ["store_id", "request_date"]


def request_history(
    wanted: DataFrame, daily: DataFrame, target: str = "sales", n: int = 30
) -> DataFrame:
    """For each distinct (store, date): the last ``n`` targets before the date, oldest first.

    History and request points form one sequence per store, which numbers the history rows and
    tells each request the number before it. A request then joins its ``n`` numbers and never
    meets the whole history of its store. Both sides are unique per store and day, which bounds
    a sequence by twice the calendar.
    """
    points = wanted.select("store_id", F.col("request_date").alias("date")).distinct()
    stores = points.select("store_id").distinct()
    past = daily.filter(F.col(target).isNotNull()).join(stores, "store_id", "left_semi")
    sequence = past.select(
        "store_id", "date", F.col(target).cast("double").alias("__y"), F.lit(1).alias("__kind")
    ).unionByName(
        points.select(
            "store_id", "date", F.lit(None).cast("double").alias("__y"), F.lit(0).alias("__kind")
        )
    )
    in_order = W.partitionBy("store_id").orderBy("date", "__kind")
    # a request shares the number of the history row before it, so a frame over the numbers
    # counts history rows only
    numbered = sequence.withColumn(
        "__h", F.sum("__kind").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    )
    asked = numbered.filter(F.col("__kind") == 0).select(
        "store_id", F.col("date").alias("request_date"), F.col("__h").alias("__last")
    )
    first = F.greatest(F.col("__last") - F.lit(n - 1), F.lit(1).cast("bigint"))
    numbers = F.when(F.col("__last") > 0, F.sequence(first, F.col("__last")))
    kept = numbered.filter(F.col("__kind") == 1).select("store_id", "__h", "__y")
    found = (
        asked.withColumn("__h", F.explode(numbers)).join(kept, ["store_id", "__h"])
        .groupBy(*REQUEST)  # n rows each
        .agg(F.sort_array(F.collect_list(F.struct("__h", "__y")))["__y"].alias("history"))
    )
    return asked.join(found, REQUEST, "left").select(
        *REQUEST, F.coalesce("history", F.array().cast("array<double>")).alias("history")
    )


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values))


def history_features(
    history: str = "history",
    lags: list[int] | None = None,
    windows: list[int] | None = None,
    functions: list[str] | None = None,
    prefix: str = "sales",
) -> dict[str, Column]:
    """The lag and rolling columns of a request point from its history array."""
    lags = config.LAGS if lags is None else lags
    windows = config.ROLLING_WINDOWS if windows is None else windows
    functions = functions or config.ROLLING_FUNCTIONS
    past = F.col(history)
    length = F.size(past)
    out = {f"{prefix}_lag_{k}": F.when(length >= k, F.get(past, length - k)) for k in lags}
    for w in windows:
        start = F.greatest(length - F.lit(w), F.lit(0)) + 1
        tail = F.slice(past, start, w)
        for f in functions:
            out[f"{prefix}_rolling_{w}_{f}"] = _array_stat(tail, f)
    return out


def _array_stat(values: Column, name: str) -> Column:
    size = F.size(values)
    if name == "mean":
        return _mean(values)
    if name == "min":
        return F.array_min(values)
    if name == "max":
        return F.array_max(values)
    if name == "median":
        ordered = F.array_sort(values)
        low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
        high = F.get(ordered, F.floor(size / 2).cast("int"))
        return F.when(size > 0, (low + high) / 2)
    if name == "std":
        spread = F.aggregate(
            values,
            F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
            _running_moments,
        )
        return F.when(size > 1, F.sqrt(spread["m2"] / (size - 1)))
    raise ValueError(f"unknown rolling function {name}")


def _running_moments(state: Column, x: Column) -> Column:
    n = state["n"] + 1
    step = x - state["mean"]
    mean = state["mean"] + step / n
    return F.struct(
        n.alias("n"), mean.alias("mean"), (state["m2"] + step * (x - mean)).alias("m2")
    )


def _computed(spec: FeatureSpec) -> set[str]:
    """Names of the features that come from the store, the date and the history."""
    made = {*calendar.date_parts("d"), *calendar.cyclical("d"), "is_holiday", "store_id"}
    made |= set(history_features("h", spec.lags, spec.windows, spec.functions, spec.target))
    return made | set(calendar.interactions(spec.interactions))


def given_features(prepared: Prepared) -> list[str]:
    """Trained features, and parts of interactions, that a request has to bring along."""
    made = _computed(prepared.spec)
    return [f for f in dict.fromkeys([*prepared.features, *prepared.spec.interactions]) if f not in made]


def with_given(requests: DataFrame, prepared: Prepared) -> DataFrame:
    """Requests with a column for each given feature, from their additional features.

    A number that cannot be read, or is not given, is missing and becomes the training mean;
    ``has_promotion`` becomes 0.
    """
    out = {}
    for name in given_features(prepared):
        value = F.lit(None).cast("string")
        if "additional_features" in requests.columns:
            value = F.try_element_at("additional_features", F.lit(name))
        text = name in prepared.categorical or name in prepared.spec.interactions
        out[name] = value if text else value.try_cast("double")
    if "has_promotion" in out:
        out["has_promotion"] = F.coalesce(out["has_promotion"].cast("int"), F.lit(0))
    return requests.withColumns(out) if out else requests


def unusable_features(requests: DataFrame, prepared: Prepared) -> DataFrame:
    """(store_id, request_date, feature, value, reason) of additional features that have no effect."""
    known = given_features(prepared)
    numbers = [f for f in known if f not in prepared.categorical and f not in prepared.spec.interactions]
    given = requests.select(*REQUEST, F.explode("additional_features").alias("feature", "value"))
    reason = F.when(~F.col("feature").isin(*known), "not a trained feature").when(
        F.col("feature").isin(*numbers) & F.col("value").try_cast("double").isNull(), "not a number"
    )
    return given.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def split_known(requests: DataFrame, prepared: Prepared) -> tuple[DataFrame, DataFrame]:
    """Requests that all label codes cover, and the others with a reason."""
    checked = requests.withColumn("reason", F.lit(None).cast("string"))
    for name in prepared.categorical:
        if name not in checked.columns:
            continue  # an interaction: its parts are known or it becomes missing
        own = prepared.codes.filter(F.col("column") == name).select(F.col("label").alias("__label"))
        joined = checked.join(own, F.col(name).cast("string") == F.col("__label"), "left")
        unknown = F.col("__label").isNull() & F.col(name).isNotNull()
        message = F.concat(F.lit(f"unseen label in {name}: "), F.col(name).cast("string"))
        checked = joined.withColumn(
            "reason", F.coalesce("reason", F.when(unknown, message))
        ).drop("__label")
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def request_features(
    points: DataFrame, daily: DataFrame, holidays: DataFrame, spec: FeatureSpec | None = None
) -> DataFrame:
    """Features of request points (store_id, request_date and given features).

    Each point uses history before its own date only; several days ahead share the same
    history, so all points are independent and run in one job.
    """
    spec = spec or FeatureSpec()
    history = request_history(points, daily, spec.target, spec.history)
    made = history_features("history", spec.lags, spec.windows, spec.functions, spec.target)
    dated = points.join(history, REQUEST, "left").withColumns(
        {**calendar.date_parts("request_date"), **calendar.cyclical("request_date"), **made}
    )
    dated = lookups.lookup_holiday(dated, holidays, "request_date").drop("history")
    pairs = calendar.interactions(spec.interactions)
    return dated.withColumns(pairs) if pairs else dated


def batch_predict(
    requests: DataFrame,
    daily: DataFrame,
    holidays: DataFrame,
    prepared: Prepared,
    models: dict,
    weights: DataFrame,
    version: str = "v1",
) -> DataFrame:
    """One row per request and model, the ensemble included, with intervals.

    ``requests`` holds (store_id, request_date[, additional_features]); malformed dates are
    split off before, and requests with an unknown label are left out here: ``split_known`` gives
    them. Equal requests are predicted once and joined back, so a store asked for very often
    costs no more than its distinct days.
    """
    given = given_features(prepared)
    point = [*REQUEST, *given]
    asked, _ = split_known(with_given(requests, prepared).select(*point), prepared)
    features = request_features(asked.distinct(), daily, holidays, prepared.spec)
    kept = [f"__key_{c}" for c in point]
    keyed = features.withColumns({f"__key_{c}": F.col(c) for c in point})
    if prepared.categorical:
        keyed = prep.encode_apply(keyed, prepared.codes, prepared.categorical, "null")
    scaled = prep.scale_apply(keyed, prepared.scaling, prepared.features)
    vectors = prep.assemble(
        scaled.withColumn("__none", F.lit(None).cast("double")), prepared.features, "__none", kept
    )
    wide = predict_wide(models, vectors, kept)
    predicted = predict_long(wide, list(models), kept, weight_map(weights)).select(
        *kept, "model", F.round("prediction", 2).alias("prediction")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(point, kept)])
    return (
        asked.join(predicted, same).drop(*kept)
        .withColumn("date", F.date_format("request_date", "yyyy-MM-dd"))
        .withColumn("model_version", F.lit(version))
        .withColumns(intervals.interval_columns("prediction"))
        .drop("request_date")
    )


def responses(predicted: DataFrame) -> DataFrame:
    """One row per distinct request with maps of predictions and of intervals.

    A request holds a handful of models, which bounds the maps.
    """
    figures = {"model", "prediction", *intervals.interval_columns("prediction")}
    asked = [c for c in predicted.columns if c not in figures]
    grouped = predicted.groupBy(*asked).agg(
        F.array_sort(F.collect_set(F.struct("model", "prediction"))).alias("__models")
    )
    bands = F.transform(
        "__models", lambda m: F.struct(m["model"], intervals.interval_map(m["prediction"]))
    )
    return grouped.withColumns(
        {
            "predictions": F.map_from_entries("__models"),
            "intervals": F.map_from_entries(bands),
            "prediction_timestamp": F.current_timestamp(),
        }
    ).select("store_id", "date", "model_version", "predictions", "intervals", "prediction_timestamp")
