"""One linear regression per group, for all groups in one job.

A group's model follows from its covariances: one aggregation pass, combined before the shuffle,
gathers them for every group at once, and the normal equations are solved by column expressions
on one row per group. No group's rows come together in one task, so neither many groups nor one
that holds most rows is a problem.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: A feature whose variance, given the features before it, is below this share of its own is left out.
RANK_TOLERANCE = 1e-10


def _complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return rows.filter(reduce(lambda a, b: a & b, known))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def moments(rows: DataFrame, group_cols: list[str], features: list[str], target: str) -> DataFrame:
    """Per group: n, means and covariances of features and target, over rows without a missing value."""
    names = [*features, target]
    value = {c: F.col(c).cast("double") for c in names}
    covariances = [
        F.covar_pop(value[a], value[b]).alias(f"__c_{i}_{j}")
        for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])
    ]
    return _complete(rows, names).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(value[c]).alias(f"__m_{i}") for i, c in enumerate(names)], *covariances,
    )


def fit(
    rows: DataFrame, group_cols: list[str], features: list[str], target: str, ridge: float = 0.0
) -> DataFrame:
    """Coefficients per group: (group, n, intercept, coef_<feature>..., r2).

    Least squares with ``ridge`` times each feature's variance added to the diagonal, so that the
    penalty does not depend on units; the intercept is not penalised. The covariance matrix is
    factored as L D L' one column at a time. A feature that is constant in a group, or a combination
    of those before it, gets coefficient 0 there. ``r2`` is the fit on the rows themselves, null for a
    constant target; groups without a complete row are absent.
    """
    p = len(features)
    solved = moments(rows, group_cols, features, target)
    c = lambda i, j: F.col(f"__c_{max(i, j)}_{min(i, j)}")
    for j in range(p):  # each step is a projection of its own, so no expression grows with the steps
        pivot = c(j, j) * (1.0 + ridge) - _sum([F.col(f"__l_{j}_{k}") ** 2 * F.col(f"__d_{k}") for k in range(j)])
        keeps = (c(j, j) > 0) & (pivot > c(j, j) * RANK_TOLERANCE)
        solved = solved.withColumn(f"__d_{j}", F.when(keeps, pivot).otherwise(0.0))
        below = {}
        for i in [*range(j + 1, p), p]:  # row p is the target: its entries solve L D y = c
            rest = c(i, j) - _sum([F.col(f"__l_{i}_{k}") * F.col(f"__l_{j}_{k}") * F.col(f"__d_{k}") for k in range(j)])
            below[f"__l_{i}_{j}"] = F.when(F.col(f"__d_{j}") > 0, F.try_divide(rest, F.col(f"__d_{j}"))).otherwise(0.0)
        solved = solved.withColumns(below)
    for j in reversed(range(p)):
        after = _sum([F.col(f"__l_{i}_{j}") * F.col(f"__b_{i}") for i in range(j + 1, p)])
        solved = solved.withColumn(f"__b_{j}", F.when(F.col(f"__d_{j}") > 0, F.col(f"__l_{p}_{j}") - after).otherwise(0.0))
    b = [F.col(f"__b_{j}") for j in range(p)]
    intercept = F.col(f"__m_{p}") - _sum([b[j] * F.col(f"__m_{j}") for j in range(p)])
    cross = _sum([b[j] * c(p, j) for j in range(p)])
    square = _sum([b[i] * b[j] * c(i, j) for i in range(p) for j in range(p)])
    return solved.select(
        *group_cols, "n", intercept.alias("intercept"), *[b[j].alias(f"coef_{name}") for j, name in enumerate(features)],
        F.try_divide(2 * cross - square, F.when(c(p, p) > 0, c(p, p))).alias("r2"),
    )


def predict(rows: DataFrame, models: DataFrame, group_cols: list[str], features: list[str]) -> DataFrame:
    """Rows with ``prediction``; null where a feature is missing or the group has no model.

    Models are one row per group. The planner decides how they meet the rows, and AQE splits a group
    that holds too many of them.
    """
    held = models.select(*group_cols, "intercept", *[f"coef_{f}" for f in features])
    value = F.col("intercept") + _sum([F.col(f"coef_{f}") * F.col(f).cast("double") for f in features])
    return rows.join(held, group_cols, "left").withColumn("prediction", value).drop("intercept", *[f"coef_{f}" for f in features])


def train_fleet(
    rows: DataFrame, group_cols: list[str], models: dict[str, list[str]], target: str,
    keys: list[str], ridge: float = 0.0, split: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """Fit several models, given by their features, for every group on the training rows.

    Returns the coefficients (group, model, n, intercept, coefficients map, r2) and the predictions of
    the other rows (keys, group, split, model, actual, prediction), from which weights and best runs
    are taken. ``rows`` is read once per model: pass a stored table.
    """
    fitted, predicted = [], []
    for name, features in models.items():
        made = fit(rows.filter(F.col(split) == "train"), group_cols, features, target, ridge)
        pairs = [x for f in features for x in (F.lit(f), F.col(f"coef_{f}"))]
        fitted.append(made.select(*group_cols, F.lit(name).alias("model"), "n", "intercept", F.create_map(*pairs).alias("coefficients"), "r2"))
        scored = predict(rows.filter(F.col(split) != "train"), made, group_cols, features)
        own = [k for k in keys if k not in group_cols]
        predicted.append(scored.select(
            *own, *group_cols, split, F.lit(name).alias("model"), F.col(target).cast("double").alias("actual"), "prediction"
        ))
    union = lambda a, b: a.unionByName(b)
    return reduce(union, fitted), reduce(union, predicted)
