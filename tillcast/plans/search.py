"""Racing search for a learner's parameters over a stored table of trials.

All trials are fitted with a few rounds, a rung; the third with the smallest validation error is
fitted with three times as many, and so on until the last rung, which runs each survivor's own
number of rounds. No trial worse than the median of its rung goes on. Every fit is a distributed job; what it found
is stored as soon as it is known, so a search that breaks off goes on from its table and ends with
the same one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tillcast.operators import evaluate
from tillcast.session import materialize, scratch_path

#: Rounds of the rungs; None stands for a trial's own number.
RUNGS = (3, 9, 27, None)
#: Share of a rung's trials that goes on.
KEPT = 1 / 3
#: Training rows of a partition: a small table is not cut into more tasks than it feeds.
PARTITION_ROWS = 50_000

TRIALS = (
    "learner string, rung int, trial int, rounds int, params map<string,double>, rmse double"
)


@dataclass(frozen=True)
class Learner:
    """A learner to tune: its search ranges, the parameter that counts its rounds, and its fit.

    ``fit`` takes (train, validation, final, params) and returns the model and its validation RMSE;
    ``final`` tells the last rung.
    """

    name: str
    space: dict[str, tuple]
    rounds: str
    fit: Callable[[DataFrame, DataFrame, bool, dict], tuple[object, float]]


def validation_rmse(model, validation: DataFrame) -> float:
    scored = model.transform(validation).select(
        F.lit("trial").alias("model"), F.col("label").alias("actual"), "prediction"
    )
    row = evaluate.regression_metrics(scored).first()
    return float(row["rmse"]) if row and row["rmse"] is not None else math.inf


def race(
    rows: DataFrame, learner: Learner, drawn: list[dict], path: str | None = None,
    rungs: tuple = RUNGS, kept: float = KEPT, parallelism: int = 8,
) -> DataFrame:
    """Race the drawn parameters; (learner, rung, trial, rounds, params, rmse, rank, kept) of all fits.

    ``rows`` has (split, label, features) and is a stored table. ``path`` is the folder of the trial
    table: trials that are in it are not fitted again, and other parameters under the same number
    are an error. Only parameters and scores reach the driver.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "trials")
    train = rows.filter(F.col("split") == "train").select("label", "features")
    parts = max(1, -(-train.count() // PARTITION_ROWS))
    train = train.coalesce(parts)
    validation = rows.filter(F.col("split") == "val").select("label", "features").coalesce(parts)
    alive, table = list(range(len(drawn))), None
    for rung, limit in enumerate(rungs):
        final = rung == len(rungs) - 1
        folder = f"{path}/{learner.name}/rung{rung}"
        done = _known(spark, folder, drawn)

        def run(trial: int, limit=limit, rung=rung, final=final, folder=folder) -> None:
            params = dict(drawn[trial])
            own = params[learner.rounds]
            params[learner.rounds] = own if limit is None else min(limit, own)
            _, rmse = learner.fit(train, validation, final, params)
            row = (learner.name, rung, trial, params[learner.rounds], {k: float(v) for k, v in drawn[trial].items()}, rmse)
            spark.createDataFrame([row], TRIALS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trial{trial}")

        todo = [t for t in alive if t not in done]
        if todo:
            with ThreadPool(max(1, min(parallelism, len(todo)))) as pool:
                pool.map(run, todo, chunksize=1)
        # a table left by a wider search may hold more trials of this rung than are in the race
        here = spark.read.schema(TRIALS).option("recursiveFileLookup", "true").parquet(folder).filter(F.col("trial").isin(alive))
        place = W.partitionBy("learner", "rung").orderBy("rmse", "trial")
        goes_on = 1 if final else max(1, math.ceil(len(alive) * kept))
        ranked = materialize(here.withColumn("rank", F.row_number().over(place)).withColumn("kept", F.col("rank") <= goes_on), "rung")
        table = ranked if table is None else table.unionByName(ranked)
        alive = sorted(r.trial for r in ranked.filter("kept").select("trial").collect())
    return table


def _known(spark: SparkSession, folder: str, drawn: list[dict]) -> set[int]:
    """Trials of a rung that are stored completely."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return set()
    names = [status.getPath() for status in system.listStatus(root)]
    whole = [p for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return set()
    rows = spark.read.schema(TRIALS).parquet(*[p.toString() for p in whole]).collect()
    for row in rows:
        if row.trial < len(drawn) and row.params != {k: float(v) for k, v in drawn[row.trial].items()}:
            raise ValueError(f"{folder}: trial {row.trial} was made with other parameters")
    return {row.trial for row in rows}


def best(table: DataFrame, space: dict) -> dict:
    """Parameters of the last rung's best trial, whole numbers where the range has whole bounds."""
    row = table.filter("kept").orderBy(F.desc("rung"), "rank").first()
    return {k: int(v) if isinstance(space[k][0], int) else v for k, v in row["params"].items()}
