"""Run and model-version tables: the best run, the version to serve, the promotion decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast import config
from tillcast.operators import lookups


def best_model(metrics: DataFrame, group_cols: list[str], metric: str = "rmse") -> DataFrame:
    """Model with the smallest metric per group."""
    smallest = F.min(F.struct(F.col(metric), F.col("model"))).alias("__best")
    return (
        metrics.filter(F.col(metric).isNotNull())
        .groupBy(*group_cols)
        .agg(smallest)
        .select(
            *group_cols,
            F.col("__best.model").alias("best_model"),
            F.col(f"__best.{metric}").alias(f"best_{metric}"),
        )
    )


def best_run(runs: DataFrame, metric: str = "rmse", ascending: bool = True) -> DataFrame:
    """First run in the order of a metric; ties go to the smaller run id."""
    value = F.col("value").asc() if ascending else F.col("value").desc()
    named = runs.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    return named.orderBy(value, "run_id").limit(1)


def best_per_metric(metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Best model of every metric: the largest R2, the smallest of all others."""
    cost = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    keys = [*(group_cols or []), "metric"]
    best = F.min(F.struct(cost.alias("cost"), F.col("model"), F.col("value"))).alias("__best")
    return (
        metrics.filter(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(best)
        .select(*keys, F.col("__best.model").alias("model"), F.col("__best.value").alias("value"))
    )


def latest_version(
    versions: DataFrame, runs: DataFrame, stage: str = "Production", metric: str = "rmse"
) -> DataFrame:
    """Highest version of a stage per model name, else the model's best run."""
    number = F.col("version").cast("bigint")
    staged = versions.filter(F.col("stage") == stage).groupBy("name").agg(
        F.max(F.struct(number.alias("version"), F.col("run_id"))).alias("__top")
    )
    fallback = (
        runs.filter((F.col("metric") == metric) & F.col("value").isNotNull())
        .groupBy("name")
        .agg(F.min(F.struct("value", "run_id")).alias("__run"))
    )
    return (
        versions.select("name").distinct()
        .join(staged, "name", "left")
        .join(fallback, "name", "left")
        .select(
            "name",
            F.lit(stage).alias("stage"),
            F.coalesce(F.col("__top.version").cast("string"), F.col("__run.run_id"))
            .alias("version"),
            F.coalesce(F.col("__top.run_id"), F.col("__run.run_id")).alias("run_id"),
        )
    )


def version_intervals(changes: DataFrame, stage: str = "Production") -> DataFrame:
    """When each version of a model held a stage: (name, version, run_id, start, end).

    ``changes`` has (name, version, run_id, stage, date): from that date on the version is in that
    stage. A version's stage lasts until its next change, and ends at once when another version of
    the model enters ``stage`` later; of several that enter on one day the highest is taken.
    ``end`` is the last day, null where the interval is open. A model has as many rows as it had
    versions, so its window is bounded by its history.
    """
    number = F.col("version").cast("bigint")
    # the last change of a day counts for a version: the stage itself, if it is among them
    per_day = changes.groupBy("name", number.alias("version"), "date").agg(
        F.max(F.struct((F.col("stage") == stage).alias("held"), "run_id")).alias("c")
    )
    own = W.partitionBy("name", "version").orderBy("date")
    held = per_day.withColumn("left", F.lead("date").over(own)).filter("c.held")
    entered = held.groupBy("name", "date").agg(
        F.max(F.struct("version", F.col("c.run_id").alias("run_id"), "left")).alias("v")
    )
    after = F.lead("date").over(W.partitionBy("name").orderBy("date"))
    ends = F.least(F.col("v.left"), after)
    return entered.select(
        "name", "v.version", "v.run_id", F.col("date").alias("start"), F.date_sub(ends, 1).alias("end")
    )


def version_as_of(
    points: DataFrame, changes: DataFrame, stage: str = "Production", at: str = "date"
) -> DataFrame:
    """Rows of ``points`` (name, date, ...) with the version and run that held ``stage`` that day.

    Both are null where no version did. A point-in-time join on the versions' intervals: models and
    blocks of days meet by hash, and intervals of a model do not overlap, so no row is multiplied.
    """
    keys = points.select("name", at).distinct()
    found = lookups.interval_join(keys, version_intervals(changes, stage), ["name"], at)
    return points.join(found.select("name", at, "version", "run_id"), ["name", at], "left")


def compare_metrics(
    production: DataFrame,
    candidate: DataFrame,
    keys: list[str] | None = None,
    directions: dict[str, str] | None = None,
    threshold: float = config.IMPROVEMENT_THRESHOLD,
) -> DataFrame:
    """Metrics both sides have, with the improvement in percent.

    Both inputs are (keys, metric, value). ``counted`` marks an improvement of at least the
    threshold.
    """
    keys = keys or ["model"]
    directions = directions or config.COMPARED_METRICS
    lower = [m for m, d in directions.items() if d == "lower"]
    joined = (
        production.filter(F.col("metric").isin(*directions))
        .select(*keys, "metric", F.col("value").alias("production"))
        .join(
            candidate.select(*keys, "metric", F.col("value").alias("candidate")),
            [*keys, "metric"],
        )
    )
    prod, cand = F.col("production"), F.col("candidate")
    is_lower = F.col("metric").isin(*lower)
    gain = F.when(is_lower, F.try_divide(prod - cand, prod)).otherwise(
        F.try_divide(cand - prod, F.abs(prod))
    )
    better = F.when(is_lower, cand < prod).otherwise(cand > prod)
    return joined.select(
        *keys,
        "metric",
        "production",
        "candidate",
        (gain * 100).alias("improvement"),
        better.alias("is_better"),
        F.when(is_lower, "lower").otherwise("higher").alias("direction"),
        F.coalesce(better & (F.abs(gain) >= threshold), F.lit(False)).alias("counted"),
    )


def promote_decision(
    names: DataFrame,
    comparison: DataFrame,
    deployed: DataFrame,
    keys: list[str] | None = None,
    key_metrics: list[str] | None = None,
    force_first_deployment: bool = False,
) -> DataFrame:
    """Whether each named candidate replaces production, and why.

    All key metrics that were compared must be counted improvements, and at least one must
    have been compared. ``deployed`` lists the names that have a production version.
    """
    keys = keys or ["model"]
    wanted = key_metrics or config.KEY_METRICS
    is_key = F.col("metric").isin(*wanted)
    summary = comparison.groupBy(*keys).agg(
        F.count(F.when(is_key, 1)).alias("__key"),
        F.count(F.when(is_key & F.col("counted"), 1)).alias("__key_better"),
        F.count(F.when(F.col("counted"), 1)).alias("improved"),
        F.count(F.lit(1)).alias("compared"),
    )
    in_production = deployed.select(*keys).distinct().withColumn("__deployed", F.lit(True))
    improved = (F.col("__key") > 0) & (F.col("__key") == F.col("__key_better"))
    first = F.col("__deployed").isNull()
    return (
        names.select(*keys).distinct()
        .join(in_production, keys, "left")
        .join(summary, keys, "left")
        .select(
            *keys,
            F.when(first, F.lit(force_first_deployment))
            .otherwise(F.coalesce(improved, F.lit(False)))
            .alias("promoted"),
            # fixed values: the wording of the reasons
            F.when(first & F.lit(force_first_deployment), "First deployment")
            .when(first, "No production model to compare against")
            .when(F.coalesce(improved, F.lit(False)), F.concat(
                F.lit("Improved on "), F.col("improved").cast("string"), F.lit(" out of "),
                F.col("compared").cast("string"), F.lit(" metrics")))
            .otherwise("Performance not improved sufficiently")
            .alias("reason"),
        )
    )


def transition_stage(versions: DataFrame, promoted: DataFrame, stage: str = "Production") -> DataFrame:
    """Version table after promotion: the promoted version takes the stage, older ones leave it.

    ``promoted`` is (name, version) with at most one version per name.
    """
    chosen = promoted.select("name", F.col("version").alias("__promoted"))
    new_stage = (
        F.when(F.col("version") == F.col("__promoted"), stage)
        .when(F.col("__promoted").isNotNull() & (F.col("stage") == stage), "Archived")
        .otherwise(F.col("stage"))
    )
    return versions.join(chosen, "name", "left").withColumn("stage", new_stage).drop("__promoted")
