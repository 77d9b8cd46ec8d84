"""The registered model fits that test_oracles leaves out, at their default settings."""

import os
import random
from dataclasses import replace

import numpy as np
import pytest

from flowlantern.operators import kernel, metrics as me, models as mo
from flowlantern.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stratified_cv_has_every_fold_of_every_model(spark):
    rows = QUERIES["stratified_cv"](spark, SF).collect()
    names = {*mo.ModelSettings().enabled, "svm", "logistic_regression"}
    assert sorted((r.model, r.fold) for r in rows) == sorted((n, k) for n in names for k in range(5))
    for n in names:
        f1 = [r.f1 for r in rows if r.model == n]
        mean = sum(f1) / 5
        sd = (sum((x - mean) ** 2 for x in f1) / 5) ** 0.5
        assert all(r.cv_f1 == pytest.approx(mean) and r.cv_sd == pytest.approx(sd) for r in rows if r.model == n)


def test_grid_search_runs_at_default_settings(spark, monkeypatch):
    seen = []
    inner = mo.cross_validate
    monkeypatch.setattr(mo, "cross_validate", lambda df, est, grid=None, folds=5, **k: seen.append((est, folds)) or inner(df, est, grid, folds, **k))
    rows = QUERIES["grid_search"](spark, SF).collect()
    (pipe, folds), s = seen[0], mo.ModelSettings()
    assert folds == 5 and pipe.getStages()[-1].getNumTrees() == s.trees
    assert f"maxDepth={s.depth}" in {r.params for r in rows} and sum(r.best for r in rows) == 1


@pytest.mark.parametrize("name", ["kernel_svc", "detect_windows"])
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_fold_scores_are_those_of_the_folds(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 1), 0) for i in range(400)] + [(5000 + i, rng.gauss(-9, 1), rng.gauss(16, 1), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "pid bigint, a double, b double, label int")
    got = mo.fold_scores(df, ["a", "b"], ("random_forest", "isolation_forest"), folds=2, s=mo.ModelSettings(trees=5)).collect()
    assert [(r.model, r.fold) for r in got] == [(n, k) for n in ("random_forest", "isolation_forest") for k in range(2)]
    for a, b in (got[:2], got[2:]):
        assert a.cv_f1 == b.cv_f1 == pytest.approx((a.f1 + b.f1) / 2) and a.cv_sd == pytest.approx(abs(a.f1 - b.f1) / 2)
    assert got[0].cv_f1 > 0.97


def _clusters(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 1), 0) for i in range(200)] + [(5000 + i, rng.gauss(-9, 1), rng.gauss(16, 1), 1) for i in range(40)]
    return spark.createDataFrame(rows, "pid bigint, a double, b double, label int")


def test_one_class_svm_does_not_depend_on_partitions(spark):
    df = _clusters(spark).where("label = 0")
    one, many = (kernel.fit_one_class_svm(df.repartition(p), ["a", "b"]) for p in (1, 16))
    assert one.converged and one.passes == many.passes
    assert abs(one.weights - many.weights).max() < 1e-6 and one.rho == pytest.approx(many.rho, abs=1e-6)
    share = one.transform(df).agg({"prediction": "avg"}).first()[0]
    assert 0.05 < share < 0.15  # nu
    assert one.transform(_clusters(spark).where("label = 1")).agg({"prediction": "avg"}).first()[0] > 0.95


def test_the_bound_of_passes_is_reported(spark):
    with pytest.warns(UserWarning, match="stopped after 2 passes"):
        assert not kernel.fit_one_class_svm(_clusters(spark), ["a", "b"], iterations=2).converged


def test_histogram_quantile_is_within_a_bin():
    values = np.random.default_rng(2).normal(0, 0.2, 5000)
    counts, _ = np.histogram(values, bins=1000, range=(-1.5, 1.5))
    for q in (0.01, 0.1, 0.5, 0.9):
        assert abs(kernel.histogram_quantile(counts, -1.5, 1.5, q) - np.quantile(values, q)) < 0.006


@pytest.mark.parametrize("name,grid", [("isolation_forest", {"contamination": [0.01, 0.3]}), ("svm", {"cost": [1.0]}),
                                       ("logistic_regression", {"regParam": [0.01, 1.0]})])
def test_other_models_are_searched(spark, name, grid):
    s = mo.ModelSettings(trees=5, logistic_iterations=20, svm_iterations=10)
    df = _clusters(spark)
    model, table = mo.grid_search(df, ["a", "b"], grid, name, folds=2, s=s)
    rows = table.collect()
    assert len(rows) == len(next(iter(grid.values()))) and sum(r.best for r in rows) == 1
    best = max(rows, key=lambda r: r.cv_f1)
    train, test = mo.split(df)
    assert best.best and best.test_f1 == pytest.approx(mo.evaluate(name, model, test).first().f1_score, abs=1e-6)
    if name == "isolation_forest":  # each line is the score of its own setting
        for r, c in zip(rows, grid["contamination"]):
            f1 = mo.fold_scores(train, ["a", "b"], (name,), 2, replace(s, contamination=c)).first().cv_f1
            assert r.params == f"contamination={c}" and r.cv_f1 == pytest.approx(f1)
        with pytest.raises(ValueError, match="no parameter"):
            mo.grid_search(df, ["a", "b"], {"maxDepth": [3]}, name)


def test_report_shows_folds_of_classifiers(spark):
    s = mo.ModelSettings(trees=5, enabled=("random_forest", "isolation_forest"))
    table = mo.train_all(_clusters(spark), ["a", "b"], s, folds=2)[1]
    lines = {r.model: r.line for r in me.text_report(table).collect()}
    assert ", cv 0.9" in lines["random_forest"] or ", cv 1.0" in lines["random_forest"]
    assert "cv" not in lines["isolation_forest"] and lines["isolation_forest"].startswith("isolation_forest: accuracy")
