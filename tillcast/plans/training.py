"""Preprocess, train, tune, combine and judge models with Spark ML trees."""

from __future__ import annotations

import math
import random
from dataclasses import asdict, dataclass, field

from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import DataFrame, functions as F

from tillcast import config
from tillcast.operators import diagnose, evaluate, prep, split
from tillcast.plans import search
from tillcast.operators.quality import require_columns
from tillcast.plans.features import all_features
from tillcast.session import materialize
from tillcast.sources.sinks import write_table

# Default and search settings of the two learners. Column sampling and minimum gain
# go by Spark's names; the boosting libraries' L1 and L2 terms have no counterpart in Spark, and a
# number of leaves becomes a depth.
BOOSTED_DEFAULTS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": config.SEED}
FOREST_DEFAULTS = {"numTrees": 100, "maxDepth": 6, "seed": config.SEED}
BOOSTED_SEARCH = {
    "maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3),
    "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.6, 1.0), "minInfoGain": (0.0, 0.5),
}
FOREST_SEARCH = {
    "numTrees": (50, 300), "maxDepth": (3, 10), "minInstancesPerNode": (10, 50),
    "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.6, 1.0),
}


@dataclass
class FeatureSpec:
    """How features are made: the same for training and for serving."""

    lags: list[int] = field(default_factory=lambda: list(config.LAGS))
    windows: list[int] = field(default_factory=lambda: list(config.ROLLING_WINDOWS))
    functions: list[str] = field(default_factory=lambda: list(config.ROLLING_FUNCTIONS))
    interactions: list[str] = field(default_factory=list)
    target: str = config.TARGET

    @property
    def history(self) -> int:
        """Days that the deepest lag or window reaches back."""
        return max([0, *self.lags, *self.windows])

    def build(self, daily: DataFrame, holidays: DataFrame, **options) -> DataFrame:
        return all_features(
            daily, holidays, self.target, categorical_cols=self.interactions, lags=self.lags,
            windows_=self.windows, functions=self.functions, **options,
        )


@dataclass
class Prepared:
    """Rows of (keys, split, label, features) and the parameters that made them."""

    rows: DataFrame | None
    features: list[str]
    codes: DataFrame | None
    scaling: DataFrame
    categorical: list[str]
    spec: FeatureSpec = field(default_factory=FeatureSpec)


@dataclass
class Serving:
    """What a forecast needs: models, ensemble weights and preprocessing parameters."""

    models: dict
    weights: DataFrame
    prepared: Prepared


@dataclass
class Trained:
    models: dict
    predictions: DataFrame
    metrics: DataFrame
    weights: DataFrame
    importances: DataFrame
    diagnosis: DataFrame
    prepared: Prepared = field(repr=False)
    searched: DataFrame | None = None


def preprocess(
    features: DataFrame,
    target: str = config.TARGET,
    keys: tuple[str, ...] = ("date", "store_id"),
    exclude: tuple[str, ...] = ("date",),
    spec: FeatureSpec | None = None,
) -> Prepared:
    """Split by time, encode text and scale, with parameters fitted on the training rows.

    The features are written once, because the split, both parameter fits and the assembly
    read them again; so are the vectors, which every training pass reads.
    """
    require_columns(features, [target, *keys])
    kept = features.withColumns({f"__key_{k}": F.col(k) for k in keys})
    stage = split.split_chrono(materialize(kept, "features"), keys[0], keys[1:])
    columns = prep.feature_columns(
        stage, target, [*exclude, "split", *[f"__key_{k}" for k in keys]]
    )
    train = stage.filter(F.col("split") == "train")
    categorical = prep.text_columns(stage, columns)
    codes = None
    if categorical:
        codes = prep.encode_fit(train, categorical)
        stage = prep.encode_apply(stage, codes, categorical)
        train = stage.filter(F.col("split") == "train")
    scaling = materialize(prep.scale_fit(train, columns), "scaling")
    scaled = prep.scale_apply(stage, scaling, columns)
    rows = prep.assemble(scaled, columns, target, ["split", *[f"__key_{k}" for k in keys]])
    for k in keys:
        rows = rows.withColumnRenamed(f"__key_{k}", k)
    return Prepared(
        materialize(rows, "vectors", ("split",)), columns, codes, scaling, categorical,
        spec or FeatureSpec(target=target),
    )


def _settings(params: dict) -> dict:
    """Settings as Spark wants them: a share of columns is text there."""
    return {k: str(v) if k == "featureSubsetStrategy" else v for k, v in params.items()}


def boosted(**params) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction",
        **_settings({**BOOSTED_DEFAULTS, **params}),
    )


def forest(**params) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction",
        **_settings({**FOREST_DEFAULTS, **params}),
    )


def best_round(losses: list[float], patience: int) -> int:
    """The round, from 1, that a stop after ``patience`` rounds without gain settles on."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_gbt(rows: DataFrame, patience: int | None = None, **params):
    """Boosted trees on the training rows, over all rounds.

    With ``patience`` the model ends at the best round of the validation rows. The same seed gives
    the same first trees, so that model is fitted again with so many rounds.
    """
    train = rows.filter(F.col("split") == "train")
    model = boosted(**params).fit(train)
    validation = rows.filter(F.col("split") == "val")
    if patience is None or validation.limit(1).count() == 0:
        return model
    losses = model.evaluateEachIteration(validation, "squared")
    rounds = best_round(losses, patience)
    return model if rounds == len(losses) else boosted(**{**params, "maxIter": rounds}).fit(train)


def train_second(rows: DataFrame, **params):
    return forest(**params).fit(rows.filter(F.col("split") == "train"))


def draw_trials(space: dict, trials: int, seed: int = config.SEED) -> list[dict]:
    """Seeded uniform draws from the search ranges; whole bounds give whole numbers."""
    rng = random.Random(seed)
    return [
        {
            name: rng.randint(lo, hi) if isinstance(lo, int) else round(rng.uniform(lo, hi), 4)
            for name, (lo, hi) in space.items()
        }
        for _ in range(trials)
    ]


def _race_boosted(train: DataFrame, validation: DataFrame, final: bool, params: dict):
    """A rung's boosted model; in the last rung its score is that of the round patience stops at."""
    model = boosted(**params).fit(train)
    if not final:
        return model, search.validation_rmse(model, validation)
    losses = model.evaluateEachIteration(validation, "squared")
    return model, math.sqrt(losses[best_round(losses, config.EARLY_STOP) - 1])


def _race_forest(train: DataFrame, validation: DataFrame, final: bool, params: dict):
    model = forest(**params).fit(train)
    return model, search.validation_rmse(model, validation)


LEARNERS = {
    "boosted": search.Learner("boosted", BOOSTED_SEARCH, "maxIter", _race_boosted),
    "forest": search.Learner("forest", FOREST_SEARCH, "numTrees", _race_forest),
}


def tune_search(
    rows: DataFrame, learner: str = "boosted", trials: int = config.TUNING_TRIALS,
    path: str | None = None, seed: int = config.SEED, **options,
) -> DataFrame:
    """Race so many seeded draws of a learner's parameters; the table of all fits (``search.race``)."""
    chosen = LEARNERS[learner]
    return search.race(rows, chosen, draw_trials(chosen.space, trials, seed), path, **options)


def feature_importance(models: dict, features: list[str], spark) -> DataFrame:
    """Importance of every feature per model; its size is the feature list, not the data."""
    rows = [
        (name, feature, float(value))
        for name, model in models.items()
        for feature, value in zip(features, model.featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def predict_wide(models: dict, rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per key with a prediction column per model, in a single pass over the vectors."""
    wide = rows
    for name, model in models.items():
        wide = model.copy({model.predictionCol: f"pred_{name}"}).transform(wide)
    return wide.select(*keep, *[f"pred_{n}" for n in models])


def predict_long(
    wide: DataFrame, models: list[str], keep: list[str], weights: dict[str, float] | None = None
) -> DataFrame:
    """One row per key and model; with ``weights`` the ensemble too, from the row itself."""
    columns = {n: F.col(f"pred_{n}") for n in models}
    if weights is not None:
        total = sum(weights[n] for n in models)
        if not total > 0:
            raise ValueError("no model with a positive weight")
        columns["ensemble"] = sum((F.lit(weights[n]) * columns[n] for n in models), F.lit(0.0)) / total
    return wide.select(
        *keep,
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("model"), c.alias("prediction")) for n, c in columns.items()
        ])),
    )


def weight_map(weights: DataFrame) -> dict[str, float]:
    """Ensemble weights by model: a handful of rows."""
    return {r["model"]: r["weight"] for r in weights.select("model", "weight").collect()}


def train_pipeline(
    features: DataFrame,
    target: str = config.TARGET,
    keys: tuple[str, ...] = ("date", "store_id"),
    boosted_params: dict | None = None,
    forest_params: dict | None = None,
    trials: int = config.TUNING_TRIALS,
    spec: FeatureSpec | None = None,
    search_path: str | None = None,
    search_options: dict | None = None,
) -> Trained:
    """Train both learners, weight the ensemble by validation R2 and judge all on test.

    The parameters come from a race of ``trials`` draws per learner, stored below ``search_path``
    so that a run that breaks off need not repeat it; 0 takes them as given. The final fits use all
    rounds of their parameters. ``spec`` tells how the features were made, for
    serving.
    """
    prepared = preprocess(features, target, keys, spec=spec)
    rows = prepared.rows
    boosted_params, forest_params = dict(boosted_params or {}), dict(forest_params or {})
    searched = None
    if trials:
        tables = {n: tune_search(rows, n, trials, search_path, **(search_options or {})) for n in LEARNERS}
        boosted_params |= search.best(tables["boosted"], BOOSTED_SEARCH)
        forest_params |= search.best(tables["forest"], FOREST_SEARCH)
        searched = tables["boosted"].unionByName(tables["forest"])
    models = {
        "boosted": train_gbt(rows, **boosted_params),
        "forest": train_second(rows, **forest_params),
    }
    names, kept = list(models), [*keys, "actual"]
    wide = materialize(
        predict_wide(
            models,
            rows.filter(F.col("split") != "train").withColumn("actual", F.col("label")),
            [*kept, "split"],
        ),
        "predictions",
        ("split",),
    )
    validation = predict_long(wide.filter(F.col("split") == "val"), names, kept)
    weights = materialize(
        evaluate.ensemble_weights(evaluate.regression_metrics(validation)), "weights"
    )
    test = wide.filter(F.col("split") == "test")
    predictions = predict_long(test, names, kept, weight_map(weights))
    data = rows.select("split", F.col("label").alias(target), "features")
    return Trained(
        models=models,
        predictions=predictions,
        metrics=evaluate.regression_metrics(predictions),
        weights=weights,
        importances=feature_importance(models, prepared.features, features.sparkSession),
        diagnosis=diagnose.diagnosis_report(
            _unpack(data, target, prepared.features), predictions, target, prepared.features
        ),
        prepared=prepared,
        searched=searched,
    )


def _unpack(rows: DataFrame, target: str, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    values = rows.withColumn("__v", vector_to_array("features"))
    return values.select(
        "split", target, *[F.col("__v")[i].alias(name) for i, name in enumerate(features)]
    )


SPEC_SCHEMA = (
    "lags array<int>, windows array<int>, functions array<string>, interactions array<string>, target string"
)
_MODEL_KINDS = {"boosted": GBTRegressionModel, "forest": RandomForestRegressionModel}


def save_serving(trained: Trained | Serving, path: str) -> None:
    """Save models, weights, label codes, scaling and the ordered feature list below ``path``."""
    spark = trained.weights.sparkSession
    for name, model in trained.models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    prepared = trained.prepared
    write_table(trained.weights, f"{path}/weights")
    write_table(prepared.scaling, f"{path}/scaling")
    if prepared.codes is not None:
        write_table(prepared.codes, f"{path}/codes")
    layout = [
        (i, name, name in prepared.categorical) for i, name in enumerate(prepared.features)
    ]
    write_table(
        spark.createDataFrame(layout, "position int, feature string, categorical boolean"),
        f"{path}/features",
    )
    write_table(spark.createDataFrame([asdict(prepared.spec)], SPEC_SCHEMA), f"{path}/spec")


def load_serving(spark, path: str, names: tuple[str, ...] = ("boosted", "forest")) -> Serving:
    layout = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    categorical = [r["feature"] for r in layout if r["categorical"]]
    return Serving(
        models={n: _MODEL_KINDS[n].load(f"{path}/models/{n}") for n in names},
        weights=spark.read.parquet(f"{path}/weights"),
        prepared=Prepared(
            rows=None,
            features=[r["feature"] for r in layout],
            codes=spark.read.parquet(f"{path}/codes") if categorical else None,
            scaling=spark.read.parquet(f"{path}/scaling"),
            categorical=categorical,
            spec=FeatureSpec(**spark.read.parquet(f"{path}/spec").first().asDict()),
        ),
    )
