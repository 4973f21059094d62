"""Label encoding, standard scaling and vector assembly, with parameters kept as tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tillcast.operators import ordering
from tillcast.session import materialize


def feature_columns(df: DataFrame, target: str, exclude: list[str] | None = None) -> list[str]:
    """All columns but the target and the excluded ones, in table order."""
    dropped = {target, *(exclude or [])}
    return [c for c in df.columns if c not in dropped]


def text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds[c], T.StringType)]


def encode_fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """Codes by sorted label, as (column, label, code). Any number of labels.

    One pass finds the distinct labels of all columns. They are written once, since numbering
    reads them several times, and so are the codes, which every use joins.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))
            for c in columns
        ]
    )
    labels = train.select(F.inline(pairs)).filter(F.col("label").isNotNull()).distinct()
    labels = materialize(labels, "labels")
    before = W.orderBy("column").rowsBetween(W.unboundedPreceding, -1)  # one row per column
    starts = (
        labels.groupBy("column").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )
    placed = ordering.with_position(labels, ["column", "label"], "__position")
    codes = placed.join(F.broadcast(starts), "column").select(
        "column", "label", (F.col("__position") - F.col("__start")).cast("int").alias("code")
    )
    return materialize(codes, "codes")


def encode_apply(
    df: DataFrame, codes: DataFrame, columns: list[str], unseen: str = "error"
) -> DataFrame:
    """Replace labels by their codes. An unseen label stops the job, or becomes null."""
    for name in columns:
        own = codes.filter(F.col("column") == name).select(
            F.col("label").alias("__label"), F.col("code").alias("__code")
        )
        joined = df.join(own, F.col(name).cast("string") == F.col("__label"), "left")
        code = F.col("__code")
        if unseen == "error":
            message = F.concat(F.lit(f"unseen label in {name}: "), F.col(name).cast("string"))
            code = F.when(
                F.col("__code").isNull() & F.col(name).isNotNull(),
                F.raise_error(message).cast("int"),
            ).otherwise(F.col("__code"))
        df = joined.withColumn(name, code).drop("__label", "__code")
    return df


def scale_fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean and population deviation of every column; a deviation of 0 is 1."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        deviation = F.stddev_pop(x)
        stats.append(F.avg(x).alias(f"{c}__mean"))
        stats.append(
            F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}__scale")
        )
    return train.agg(*stats)


def scale_apply(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns with fitted parameters, read once as a single-row subquery."""
    row = params.select(F.struct("*")).scalar()
    return (
        df.withColumn("__p", row)
        .withColumns(
            {
                c: (F.col(c).cast("double") - F.col(f"__p.`{c}__mean`"))
                / F.col(f"__p.`{c}__scale`")
                for c in columns
            }
        )
        .drop("__p")
    )


def assemble(df: DataFrame, columns: list[str], target: str, keep: list[str]) -> DataFrame:
    """Feature vector and label. A missing scaled value becomes 0, the training mean."""
    filled = df.select(
        *keep,
        F.col(target).cast("double").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
    )
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(filled)
    return vectors.select(*keep, "label", "features")
