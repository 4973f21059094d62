"""Tables behind the model-comparison charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.functions.intervals import interval
from tillcast.operators import ordering
from tillcast.operators.quantiles import exact_quantiles, pivot_quantiles
from tillcast.operators.windows import top_k
from tillcast.session import materialize, small


def metrics_table(metrics: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row per model with a column per metric, missing ones 0, and which it is best at.

    ``metrics`` is (model, metric, value).
    """
    wanted = wanted or ["rmse", "mae", "mape", "r2"]
    table = metrics.groupBy("model").pivot("metric", wanted).agg(F.first("value"))

    def cost(name: str) -> Column:
        return -F.col(name) if name == "r2" else F.col(name)

    # one row with the best model of each metric; ties go to the first name
    table = materialize(table, "metrics")
    best = table.agg(
        F.struct(*[F.min(F.when(F.col(m).isNotNull(), F.struct(cost(m).alias("c"), "model"))).alias(m) for m in wanted]).alias("b")
    ).scalar()
    flagged = table.withColumn("__best", best).withColumns(
        {f"best_{m}": F.coalesce(F.col(f"__best.{m}.model") == F.col("model"), F.lit(False)) for m in wanted}
    )
    return flagged.drop("__best").fillna(0.0, wanted)


def prefixed_metrics(runs: DataFrame, models: list[str], name: str = "metric") -> DataFrame:
    """Split ``<model>_<metric>`` names into model and metric; other names are left out."""
    model = F.lit(None).cast("string")
    for m in models:
        model = F.when(F.startswith(F.col(name), F.lit(f"{m}_")), m).otherwise(model)
    return (
        runs.withColumn("model", model)
        .filter(F.col("model").isNotNull())
        .withColumn(name, F.expr(f"substring({name}, length(model) + 2)"))
    )


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Date, actual, prediction and the 95 % bounds per model."""
    low, high = interval("prediction", "0.95")
    return predictions.select(
        "model", "date", "store_id", "actual", "prediction",
        low.alias("prediction_lower"), high.alias("prediction_upper"),
    )


def residual_table(predictions: DataFrame) -> DataFrame:
    return predictions.filter(
        F.col("prediction").isNotNull() & F.col("actual").isNotNull()
    ).withColumn("residual", F.col("actual") - F.col("prediction"))


def boxplot_table(residuals: DataFrame, value: str = "residual", group: str = "model") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and outlier count per model."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    quartiles = pivot_quantiles(
        exact_quantiles(residuals, value, list(names), [group]), [group], names
    )
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - spread) & (F.col(value) <= F.col("q3") + spread)
    return (
        residuals.join(small(materialize(quartiles, "quartiles")), group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )


# Rational approximation of the inverse normal distribution by P. J. Acklam,
# relative error below 1.15e-9.
ACKLAM_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
ACKLAM_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
]
ACKLAM_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
ACKLAM_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00,
]
ACKLAM_TAIL = 0.02425


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""

    def tail(q: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.ln(q))
        return _polynomial(ACKLAM_C, t) / (_polynomial(ACKLAM_D, t) * t + F.lit(1.0))

    centred = p - F.lit(0.5)
    r = centred * centred
    centre = _polynomial(ACKLAM_A, r) * centred / (_polynomial(ACKLAM_B, r) * r + F.lit(1.0))
    return (
        F.when(p < ACKLAM_TAIL, tail(p))
        .when(p > 1 - ACKLAM_TAIL, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def qq_table(residuals: DataFrame, keys: list[str], value: str = "residual", group: str = "model") -> DataFrame:
    """Sample quantiles against normal quantiles, ordered without collecting a model in a task."""
    placed = ordering.with_position(residuals, [group, value, *keys], "__position")
    before = W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)  # one row per model
    groups = (
        residuals.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    i = F.col("__position") - F.col("__first") + 1
    n = F.col("n")
    # Filliben's order statistic medians
    edge = F.pow(F.lit(0.5), F.lit(1.0) / n)
    p = (
        F.when(i == n, edge)
        .when(i == 1, F.lit(1.0) - edge)
        .otherwise((i - F.lit(0.3175)) / (n + F.lit(0.365)))
    )
    return placed.join(small(materialize(groups, "groups")), group).select(
        group, *keys, i.alias("rank"), F.col(value).alias("sample_quantile"),
        normal_quantile(p).alias("theoretical_quantile"),
    )


def error_histogram(residuals: DataFrame, bins: int = 50, group: str = "model") -> DataFrame:
    """Density of the absolute error in equal bins between its extremes, per model.

    The last bin includes its upper edge. A single value gets a range of 1 around it.
    """
    errors = residuals.select(group, F.abs("residual").alias("error"))
    flat = F.when(F.min("error") == F.max("error"), 0.5).otherwise(0.0)
    span = errors.groupBy(group).agg(
        (F.min("error") - flat).alias("lo"),
        (F.max("error") + flat).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    index = F.least(
        F.floor((F.col("error") - F.col("lo")) / F.col("width")), F.lit(bins - 1)
    ).cast("int")
    counted = (
        errors.join(small(materialize(span.withColumn("width", width), "spans")), group)
        .groupBy(group, "lo", "width", "n", index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.select(
        group, "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        "count",
        (F.col("count").cast("double") / (F.col("n") * F.col("width"))).alias("density"),
    )


def importance_table(importances: DataFrame, k: int = 20, group: str = "model") -> DataFrame:
    """The k most important features per model."""
    return top_k(importances, k, [group], "importance", "feature")
