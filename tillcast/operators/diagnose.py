"""Diagnostics of splits, features and predictions, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillcast import config
from tillcast.operators.quantiles import exact_quantiles, pivot_quantiles
from tillcast.session import materialize, small


def iqr_bounds(df: DataFrame, value: str, group_cols: list[str]) -> DataFrame:
    """Bounds at 1.5 interquartile ranges per group, stored."""
    quartiles = pivot_quantiles(
        exact_quantiles(df, value, [0.25, 0.75], group_cols),
        group_cols,
        {0.25: "q1", 0.75: "q3"},
    )
    spread = F.col("q3") - F.col("q1")
    return materialize(
        quartiles.select(
            *group_cols,
            (F.col("q1") - 1.5 * spread).alias("lower_bound"),
            (F.col("q3") + 1.5 * spread).alias("upper_bound"),
        ),
        "bounds",
    )


def outliers_iqr(df: DataFrame, value: str, group_cols: list[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges per group (a split), with bounds and extremes."""
    x = F.col(value).cast("double")
    outside = (x < F.col("lower_bound")) | (x > F.col("upper_bound"))
    return (
        df.join(small(iqr_bounds(df, value, group_cols)), group_cols)
        .groupBy(*group_cols, "lower_bound", "upper_bound")
        .agg(
            F.count(F.when(outside, 1)).alias("outliers"),
            (F.count(F.when(outside, 1)) / F.count(F.lit(1))).alias("share"),
            F.min(F.when(outside, x)).alias("min_outlier"),
            F.max(F.when(outside, x)).alias("max_outlier"),
        )
    )


def dist_shift(
    df: DataFrame, value: str, split_col: str = "split", limit: float = config.SHIFT_LIMIT
) -> DataFrame:
    """Mean and deviation per split and the shift of its mean against train."""
    x = F.col(value).cast("double")
    stats = df.groupBy(split_col).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n")
    )
    train = stats.filter(F.col(split_col) == "train").select(
        F.struct("mean", "std").alias("t")
    ).scalar()
    scale = F.greatest(F.abs("__t.mean"), F.col("__t.std"), F.lit(1e-8))
    return (
        stats.withColumn("__t", train)
        .withColumn("mean_shift", F.abs(F.col("mean") - F.col("__t.mean")) / scale)
        .withColumn("flagged", F.col("mean_shift") > limit)
        .drop("__t")
    )


def pred_extremes(predictions: DataFrame) -> DataFrame:
    """Per model: predictions far below or above all actual values, and the real residuals."""
    scored = predictions.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    span = scored.agg(
        F.struct(F.min("actual").alias("lo"), F.max("actual").alias("hi")).alias("s")
    ).scalar()
    p, y = F.col("prediction"), F.col("actual")
    residual = y - p
    return (
        scored.withColumn("__s", span)
        .groupBy("model")
        .agg(
            F.avg(p).alias("pred_mean"),
            F.stddev_pop(p).alias("pred_std"),
            F.count(F.when(p < F.col("__s.lo") * 0.5, 1)).alias("extreme_low"),
            F.count(F.when(p > F.col("__s.hi") * 1.5, 1)).alias("extreme_high"),
            F.avg(residual).alias("residual_mean"),
            F.stddev_pop(residual).alias("residual_std"),
            (F.avg(F.when(y != 0, F.abs(residual / y))) * 100).alias("mape"),
        )
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(
    df: DataFrame, columns: list[str], target: str, group_cols: list[str] | None = None
) -> DataFrame:
    """Correlation of every column with the target in one pass, as (group, feature, corr)."""
    group_cols = group_cols or []
    y = F.col(target).cast("double")
    wide = df.groupBy(*group_cols).agg(
        *[correlation(F.col(c).cast("double"), y).alias(c) for c in columns]
    )
    return wide.unpivot(group_cols, columns, "feature", "corr")


def leakage_corr(
    df: DataFrame, columns: list[str], target: str, limit: float = config.LEAKAGE_LIMIT
) -> DataFrame:
    """Correlations with those above the limit flagged. The target itself never takes part."""
    used = [c for c in columns if c != target]
    return correlations(df, used, target).withColumn(
        "flagged", F.coalesce(F.abs("corr") > limit, F.lit(False))
    )


def zero_target(
    df: DataFrame, target: str, split_col: str = "split", limit: float = config.ZERO_SHARE_LIMIT
) -> DataFrame:
    """Share of zero targets per split."""
    return (
        df.groupBy(split_col)
        .agg(
            F.count(F.when(F.col(target) == 0, 1)).alias("zeros"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("flagged", F.col("zeros") > F.col("n") * limit)
    )


def sample_size(
    df: DataFrame, split_col: str = "split", minimum: int = config.MIN_TRAINING_ROWS
) -> DataFrame:
    """Rows per split; a small training split is flagged."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "flagged", (F.col(split_col) == "train") & (F.col("n") <= minimum)
    )


def variance_topk(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k numeric columns with the largest positive sample variance."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    return (
        wide.unpivot([], columns, "feature", "variance")
        .filter(F.col("variance") > 0)
        .orderBy(F.col("variance").desc(), "feature")
        .limit(k)
    )


def diagnosis_report(
    data: DataFrame,
    predictions: DataFrame,
    target: str,
    feature_cols: list[str],
    split_col: str = "split",
) -> DataFrame:
    """All checks and the analysis of predictions as (check, subject, value, flagged, message).

    The data are read three times: a sketch, the values around the quartiles, and one grouped
    pass for everything else; the predictions twice. Pass stored tables.
    """
    return _data_checks(data, target, feature_cols, split_col).unionByName(
        _prediction_checks(predictions)
    )


def _row(check: str, subject: Column, value: Column, flagged: Column | None = None, message: str = "") -> Column:
    flagged = F.lit(False) if flagged is None else flagged
    return F.struct(
        F.lit(check).alias("check"), subject.cast("string").alias("subject"),
        value.cast("double").alias("value"), flagged.alias("flagged"),
        F.when(flagged, F.lit(message)).alias("message"),
    )


def _data_checks(data: DataFrame, target: str, feature_cols: list[str], split_col: str) -> DataFrame:
    y = F.col(target).cast("double")
    outside = (y < F.col("lower_bound")) | (y > F.col("upper_bound"))
    used = [c for c in feature_cols if c != target]
    stats = data.join(small(iqr_bounds(data, target, [split_col])), split_col).groupBy(
        F.col(split_col).alias("split"), "lower_bound", "upper_bound"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(outside, 1)).alias("outliers"),
        F.count(F.when(F.col(target) == 0, 1)).alias("zeros"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.array(*[correlation(F.col(c).cast("double"), y) for c in used]).alias("corr"),
    )
    # one row per split; a row of them all lets each see the training split
    all_splits = stats.agg(F.collect_list(F.struct("*")).alias("s"))
    train = F.get(F.filter("s", lambda x: x["split"] == "train"), F.lit(0))
    each = all_splits.select(train.alias("t"), F.explode("s").alias("x")).select("t", "x.*")
    split, is_train = F.col("split"), F.col("split") == "train"
    scale = F.greatest(F.abs(F.col("t.mean")), F.col("t.std"), F.lit(1e-8))
    shift = F.abs(F.col("mean") - F.col("t.mean")) / scale
    n_features = F.lit(len(feature_cols))
    every = [
        _row("outliers", split, F.col("outliers") / F.col("n")),
        _row("outlier_lower_bound", split, F.col("lower_bound")),
        _row("outlier_upper_bound", split, F.col("upper_bound")),
        _row("distribution_shift", split, shift, shift > config.SHIFT_LIMIT,
             "significant distribution shift against train"),
        _row("sample_size", split, F.col("n"),
             is_train & (F.col("n") <= config.MIN_TRAINING_ROWS), "small training set"),
    ]
    trained = [
        _row("zero_target", split, F.col("zeros") / F.col("n"),
             F.col("zeros") > F.col("n") * config.ZERO_SHARE_LIMIT, "many zero values in training"),
        _row("feature_count", split, n_features, n_features > config.MAX_FEATURES,
             "high number of features"),
        *[
            _row("leakage", F.lit(c), F.col("corr")[i],
                 F.coalesce(F.abs(F.col("corr")[i]) > config.LEAKAGE_LIMIT, F.lit(False)),
                 "potential data leakage")
            for i, c in enumerate(used)
        ],
    ]
    rows = F.when(is_train, F.array(*every, *trained)).otherwise(F.array(*every))
    return each.select(F.inline(rows))


def _prediction_checks(predictions: DataFrame) -> DataFrame:
    figures = [
        "pred_mean", "pred_std", "residual_mean", "residual_std", "mape", "extreme_low", "extreme_high",
    ]
    model = F.col("model")
    return pred_extremes(predictions).select(F.inline(F.array(*[_row(f, model, F.col(f)) for f in figures])))
