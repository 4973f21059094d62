"""Error metrics and the weighted ensemble, for one model set or a fleet keyed by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast import config

METRICS = ["rmse", "mae", "mape", "mae_x100", "r2"]


def join_actual(
    predictions: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("date", "store_id"),
    target: str = "sales",
) -> DataFrame:
    """Predictions with the actual value of the same key."""
    truth = actual.select(*keys, F.col(target).cast("double").alias("actual"))
    return predictions.join(truth, list(keys), "inner")


def regression_metrics(predictions: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, MAPE and R2 per group in one pass.

    MAPE skips rows whose actual value is 0; ``mae_x100`` is the undivided variant. R2 is
    1 - SSE/SST and null for a constant actual value.
    """
    group_cols = group_cols or ["model"]
    scored = predictions.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    error = F.col("actual") - F.col("prediction")
    relative = F.when(F.col("actual") != 0, F.abs(error) / F.abs(F.col("actual")))
    return scored.groupBy(*group_cols).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(relative) * 100).alias("mape"),
        (F.avg(F.abs(error)) * 100).alias("mae_x100"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop("actual"))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics_long(metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Rows of (group, metric, value)."""
    present = [m for m in METRICS if m in metrics.columns]
    return metrics.unpivot(group_cols or ["model"], present, "metric", "value")


def ensemble_weights(
    metrics: DataFrame,
    group_cols: list[str] | None = None,
    optional: tuple[str, ...] = (),
    minimum: float = config.MIN_ENSEMBLE_WEIGHT,
) -> DataFrame:
    """Weight per model from R2, at least ``minimum`` before they are scaled to sum 1.

    A negative R2 counts as 0; if all do, weights are equal. An ``optional`` model without a
    positive R2 gets weight 0.
    """
    group_cols = group_cols or []
    group = W.partitionBy(*group_cols)  # a handful of models per group
    score = F.greatest(F.coalesce(F.col("r2"), F.lit(0.0)), F.lit(0.0))
    share = F.coalesce(
        F.try_divide(F.col("__score"), F.sum("__score").over(group)),
        F.lit(1.0) / F.count(F.lit(1)).over(group),
    )
    skipped = F.col("model").isin(*optional) & (F.col("__score") == 0) if optional else F.lit(False)
    raw = F.when(skipped, 0.0).otherwise(F.greatest(F.lit(float(minimum)), F.col("__share")))
    return (
        metrics.withColumn("__score", score)
        .withColumn("__share", share)
        .withColumn("__raw", raw)
        .withColumn("weight", F.col("__raw") / F.sum("__raw").over(group))
        .select(*group_cols, "model", "weight")
    )


def ensemble_predict(
    predictions: DataFrame,
    weights: DataFrame | None = None,
    keys: tuple[str, ...] = ("date", "store_id"),
    weight_keys: tuple[str, ...] = ("model",),
) -> DataFrame:
    """Weighted mean over the models of each key; equal weights by default.

    Weights keyed by model alone are a handful of rows and are broadcast; weights of a fleet
    are joined as the planner sees fit. A key without a positive weight is an error.
    """
    if weights is None:
        weighted = predictions.withColumn("weight", F.lit(1.0))
    else:
        side = F.broadcast(weights) if tuple(weight_keys) == ("model",) else weights
        weighted = predictions.join(side, list(weight_keys), "inner")
    total = F.sum("weight")
    return weighted.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.col("weight") * F.col("prediction")) / total)
        .otherwise(F.raise_error(F.lit("no model with a positive weight")).cast("double"))
        .alias("prediction")
    )


def sample_seeded(
    df: DataFrame, keys: list[str], n: int = config.SAMPLE_ROWS, seed: int = config.SEED
) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash: a uniform sample that can be repeated."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *keys).limit(n)


def holdout_validate(
    predictions: DataFrame, keys: list[str] | None = None, n: int | None = None,
    seed: int = config.SEED,
) -> DataFrame:
    """Error metrics per model over all rows, with their number.

    A caller who wants a seeded sample of ``n`` rows instead names the ``keys`` to draw by.
    """
    judged = predictions if n is None else sample_seeded(predictions, keys, n, seed)
    return regression_metrics(judged).select(
        "model",
        F.col("rmse").alias("validation_rmse"),
        F.col("mae").alias("validation_mae"),
        F.col("r2").alias("validation_r2"),
        F.col("n").alias("validation_samples"),
    )
