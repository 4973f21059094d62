"""Exact interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch first
brackets each quantile; a second pass keeps single values only inside the bracket and collapses
everything else to two rows. What is kept is counted up over sorted ranges of bounded size, so no
task holds a bracket either, however many values lie in it. The sketches can be kept as a table, one
per day and group, so that later quantiles merge them and scan the values once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.operators import ordering
from tillcast.session import materialize, small

ACCURACY = 10_000
#: Size of a stored sketch; its rank error is about 2.3 / SKETCH_SIZE ** 0.9.
SKETCH_SIZE = 2048


def sketches(df: DataFrame, value: str, group_cols: list[str], by: str = "date", size: int = SKETCH_SIZE) -> DataFrame:
    """(group, by, sketch, n): a mergeable KLL sketch of the values of every group and day.

    Stored once per delivery, it stands for a scan of the values; a corrected day replaces its row.
    """
    values = df.select(*group_cols, by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    return values.groupBy(*group_cols, by).agg(
        F.kll_sketch_agg_double("__v", size).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    group_cols: list[str],
    accuracy: int = ACCURACY,
    range_rows: int = ordering.RANGE_ROWS,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Rows of (group, probability, quantile) with linear interpolation; nulls are skipped.

    ``stored`` gives the sketches of the same rows (``sketches``), which then are not scanned to
    find the brackets. The brackets are broadcast if the groups are few. A quantile that the sketch
    has put outside its bracket is looked for again in a wider one, at last among all values.
    """
    data = df.select(*group_cols, F.col(value).cast("double").alias("__v")).filter(
        F.col("__v").isNotNull()
    )
    # four times the rank error the sketch promises
    margin, done = (4.0 / accuracy if stored is None else 10.0 / SKETCH_SIZE**0.9), None
    while True:
        sketched = _bracketed if stored is None else partial(_bracketed, stored=stored)
        found = materialize(
            sketched(data, probabilities, group_cols, accuracy, margin, range_rows), "quantiles"
        )
        sure = found.filter("quantile is not null")
        done = sure if done is None else done.unionByName(sure)
        missed = found.filter("quantile is null").select(*group_cols, "probability")
        if margin >= 1.0 or missed.limit(1).count() == 0:
            return done
        margin = min(1.0, margin * 16)
        probabilities = [r[0] for r in missed.select("probability").distinct().collect()]  # of those asked for
        if group_cols:
            data = data.join(missed.select(*group_cols).distinct(), group_cols, "left_semi")
            # a group comes again with all missed probabilities; those it has already stay as they are
            done = done.join(missed, [*group_cols, "probability"], "left_anti")


def _bracketed(
    data: DataFrame, probabilities: list[float], group_cols: list[str], accuracy: int,
    margin: float, range_rows: int, stored: DataFrame | None = None,
) -> DataFrame:
    """One attempt; the quantile is null where the bracket does not hold it."""
    points = [
        bound
        for p in probabilities
        for bound in (max(0.0, p - margin), min(1.0, p + margin))
    ]
    if stored is None:
        sketch = data.groupBy(*group_cols).agg(
            F.percentile_approx("__v", points, accuracy).alias("__bounds"),
            F.count(F.lit(1)).alias("__total"),
        )
    else:
        merged = stored.groupBy(*group_cols).agg(F.kll_merge_agg_double("sketch").alias("__s"), F.sum("n").alias("__total"))
        bounds = F.array(*[F.kll_sketch_get_quantile_double("__s", F.lit(float(x))) for x in points])
        sketch = merged.select(*group_cols, bounds.alias("__bounds"), "__total")
    # brackets of a group travel as one array, so the join does not multiply rows
    per_group = sketch.select(
        *group_cols,
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("probability"),
                    F.element_at("__bounds", 2 * i + 1).alias("lo"),
                    F.element_at("__bounds", 2 * i + 2).alias("hi"),
                    "__total",
                )
                for i, p in enumerate(probabilities)
            ]
        ).alias("__brackets"),
    )
    if not group_cols:
        joined = data.withColumn("__brackets", per_group.select("__brackets").scalar())
    else:
        joined = data.join(small(materialize(per_group, "brackets")), group_cols)
    zone = (
        F.when(F.col("__v") < F.col("__b.lo"), 0)
        .when(F.col("__v") > F.col("__b.hi"), 2)
        .otherwise(1)
    )
    keys = [*group_cols, "probability"]
    counted = (
        joined.withColumn("__b", F.explode("__brackets"))
        .select(
            *group_cols,
            F.col("__b.probability").alias("probability"),
            F.col("__b.__total").alias("__total"),
            zone.alias("__zone"),
            "__v",
        )
        .groupBy(*keys, "__total", "__zone", F.when(F.col("__zone") == 1, F.col("__v")).alias("__single"))
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min("__v").alias("__min"),
            F.max("__v").alias("__max"),
        )
    )
    counted = materialize(counted, "counted")
    kept = counted.count()
    place = F.col("probability") * (F.col("__total") - 1)
    if kept <= range_rows:  # all in one range: a key's rows are counted up in one window
        upto = W.partitionBy(*keys).orderBy("__zone", "__single").rowsBetween(W.unboundedPreceding, 0)
        cumulated = counted.withColumns({"__cum": F.sum("__n").over(upto), "__from": F.lit(0)})
    else:
        cumulated = _over_ranges(counted, keys, kept, range_rows)
    ranked = cumulated.withColumns(
        {"__start": F.col("__cum") - F.col("__n") - F.col("__from"), "__end": F.col("__cum") - 1 - F.col("__from")}
    )

    def value_at(rank):
        covered = (F.col("__start") <= rank) & (rank <= F.col("__end"))
        known = (
            F.when(F.col("__zone") == 1, F.col("__single"))
            .when((F.col("__zone") == 0) & (rank == F.col("__end")), F.col("__max"))
            .when((F.col("__zone") == 2) & (rank == F.col("__start")), F.col("__min"))
        )
        return F.max(F.when(covered, known))

    ends = ranked.groupBy(*keys, "__total").agg(
        value_at(F.floor(place)).alias("__low"), value_at(F.ceil(place)).alias("__high")
    )
    quantile = F.col("__low") + (F.col("__high") - F.col("__low")) * (place - F.floor(place))
    return ends.select(*keys, quantile.alias("quantile"))


def _over_ranges(counted: DataFrame, keys: list[str], kept: int, range_rows: int) -> DataFrame:
    """Running counts over sorted ranges, and where each key's counts start."""
    order = [*keys, "__zone", "__single"]
    ranged = ordering.with_range(counted, order, "__range", kept, range_rows)
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("__range").agg(F.sum("__n").alias("__sum")).select(
        "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(small(materialize(offsets, "offsets")), "__range").withColumn(
        "__cum", F.col("__offset") + F.sum("__n").over(inside)
    )
    # the rows of a key lie together in this order, so its first row tells where it starts
    starts = placed.groupBy(*keys).agg(F.min(F.col("__cum") - F.col("__n")).alias("__from"))
    return placed.join(small(materialize(starts, "starts")), keys)


def pivot_quantiles(quantiles: DataFrame, group_cols: list[str], names: dict[float, str]) -> DataFrame:
    """One row per group with a column per probability."""
    return quantiles.groupBy(*group_cols).agg(
        *[
            F.max(F.when(F.col("probability") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for p, name in names.items()
        ]
    )
