"""The racing search and training with it."""

import dataclasses
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from checks.views import Tables
from tillcast.plans import search, training


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    made = []
    for i in range(300):
        x, y = draw.random(), draw.random()
        made.append(("train" if i < 200 else "val" if i < 260 else "test", 10 * x + (3 if y > 0.5 else 0), Vectors.dense(x, y)))
    frame = spark.createDataFrame(made, ["split", "label", "features"])
    return frame.cache()


SPACE = {"numTrees": (2, 8), "maxDepth": (1, 4)}


def learner(calls, fail_at=None):
    def fit(train, validation, final, params):
        if fail_at is not None and len(calls) >= fail_at:
            raise RuntimeError("lost")
        calls.append((params["numTrees"], params["maxDepth"], final))
        return training._race_forest(train, validation, final, params)

    return search.Learner("forest", SPACE, "numTrees", fit)


def table(frame):
    return sorted((r.rung, r.trial, r.rounds, tuple(sorted(r.params.items())), r.rmse, r["rank"], r.kept) for r in frame.collect())


def test_half_goes_on_and_scores_are_real(spark, rows):
    drawn = training.draw_trials(SPACE, 6)
    found = table(search.race(rows, learner([]), drawn, rungs=(1, 3, None), kept=0.5, parallelism=3))
    by_rung = {k: [r for r in found if r[0] == k] for k in (0, 1, 2)}
    assert [len(by_rung[k]) for k in (0, 1, 2)] == [6, 3, 2]
    for k in (0, 1):
        alive = {r[1] for r in by_rung[k] if r[6]}
        assert alive == {r[1] for r in by_rung[k + 1]}
        assert alive == {r[1] for r in sorted(by_rung[k], key=lambda r: (r[4], r[1]))[: len(alive)]}
    assert sum(r[6] for r in by_rung[2]) == 1
    # every score is that of a second fit, judged by hand
    for rung, trial, rounds, params, rmse, *_ in found:
        own = {k: int(v) for k, v in params}
        assert own == drawn[trial] and rounds == min(own["numTrees"], (1, 3, 99)[rung])
        if rung:
            model = training.forest(**{**own, "numTrees": rounds}).fit(rows.filter("split = 'train'").coalesce(1))
            scored = model.transform(rows.filter("split = 'val'")).select("label", "prediction").collect()
            assert rmse == pytest.approx((sum((a - b) ** 2 for a, b in scored) / len(scored)) ** 0.5, rel=1e-9)


def test_a_broken_search_goes_on_from_its_table(spark, rows, tmp_path):
    drawn = training.draw_trials(SPACE, 5)
    options = {"rungs": (1, None), "kept": 0.4, "parallelism": 1}
    calls: list = []
    whole = table(search.race(rows, learner(calls), drawn, f"{tmp_path}/whole", **options))
    assert len(calls) == 5 + 2
    for fail_at in (3, 6):
        path, first, rest = f"{tmp_path}/broken{fail_at}", [], []
        with pytest.raises(RuntimeError):
            search.race(rows, learner(first, fail_at), drawn, path, **options)
        assert table(search.race(rows, learner(rest), drawn, path, **options)) == whole
        assert len(first) == fail_at and len(rest) == 7 - fail_at
    calls.clear()
    assert table(search.race(rows, learner(calls), drawn, f"{tmp_path}/whole", **options)) == whole and not calls
    with pytest.raises(ValueError, match="other parameters"):
        search.race(rows, learner([]), training.draw_trials(SPACE, 5, seed=1), f"{tmp_path}/whole", **options)


def test_both_learners_race(rows):
    for name, chosen in training.LEARNERS.items():
        small = dataclasses.replace(chosen, space={**chosen.space, chosen.rounds: (2, 5), "maxDepth": (2, 3)})
        drawn = training.draw_trials(small.space, 3)
        made = search.race(rows, small, drawn, rungs=(1, None))
        best = search.best(made, small.space)
        assert best in drawn and isinstance(best[small.rounds], int) and isinstance(best["subsamplingRate"], float)
        row = made.filter("kept").orderBy(F.desc("rung")).first()
        assert row.learner == name and 0 < row.rmse < 10


def test_training_takes_what_the_search_found(spark, sf_dir, monkeypatch):
    for name in ("BOOSTED_SEARCH", "FOREST_SEARCH"):
        monkeypatch.setitem(getattr(training, name), "maxDepth", (2, 3))
    monkeypatch.setitem(training.BOOSTED_SEARCH, "maxIter", (2, 4))
    monkeypatch.setitem(training.FOREST_SEARCH, "numTrees", (2, 4))
    made = training.train_pipeline(Tables(spark, sf_dir).features, trials=2, search_options={"rungs": (1, None)})
    for name, key in (("boosted", "maxIter"), ("forest", "numTrees")):
        best = search.best(made.searched.filter(F.col("learner") == name), training.LEARNERS[name].space)
        assert made.models[name].getNumTrees == best[key]
    rows = made.predictions.collect()
    for r in made.metrics.collect():
        errors = [p.actual - p.prediction for p in rows if p.model == r.model]
        assert r.n == len(errors) and r.rmse == pytest.approx((sum(e * e for e in errors) / len(errors)) ** 0.5)
        assert r.mae == pytest.approx(sum(map(abs, errors)) / len(errors))
    weights = {r.model: r.weight for r in made.weights.collect()}
    assert sum(weights.values()) == pytest.approx(1)
    by_key: dict = {}
    for p in rows:
        by_key.setdefault((p.date, p.store_id), {})[p.model] = p.prediction
    for found in by_key.values():
        assert found["ensemble"] == pytest.approx(sum(weights[m] * found[m] for m in weights))
    importances = {(r.model, r.feature): r.importance for r in made.importances.collect()}
    for name, model in made.models.items():
        values = model.featureImportances.toArray()
        assert [importances[name, f] for f in made.prepared.features] == pytest.approx(list(values))
