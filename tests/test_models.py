"""Detectors on data with a known answer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlantern.operators import models as mo
from flowlantern.operators.iforest import IsolationForestModel, _average_path, _grow, fit_isolation_forest
from flowlantern.operators.kernel import _packed, added, blocks, fit_kernel_svc, fit_one_class_svm
from flowlantern.session import scratch_path

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def cloud(spark):
    """A dense cloud (label 0) and a few far points (label 1)."""
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 1), 0) for i in range(1500)]
    rows += [(5000 + i, rng.choice([-9, 9]) + rng.gauss(0, 0.5), rng.choice([-6, 16]) + rng.gauss(0, 0.5), 1) for i in range(60)]
    return spark.createDataFrame(rows, "pid bigint, a double, b double, label int").persist()


@pytest.mark.parametrize("fit", [
    lambda df: fit_isolation_forest(df, FEATURES), lambda df: fit_one_class_svm(df, FEATURES, width=64, iterations=8)])
def test_one_class_models_find_far_points(cloud, fit):
    model = fit(cloud.where("label = 0"))
    p = model.transform(cloud).groupBy("label").agg(F.avg("prediction").alias("share")).collect()
    share = {r.label: r.share for r in p}
    assert share[1] > 0.95 and share[0] == pytest.approx(0.1, abs=0.03)


def test_isolation_forest_is_repeatable_and_bounded(cloud):
    a, b = (fit_isolation_forest(cloud.repartition(n), FEATURES, trees=20, sample=64) for n in (2, 5))
    assert a.threshold == b.threshold and len(a.trees) == 20
    assert max(len(t["feature"]) for t in a.trees) <= 2 * 64 * 2


def test_one_class_training_uses_all_rows_without_normal_ones(cloud):
    assert mo.normal_rows(cloud.where("label = 1")).count() == 60


def test_kernel_svc_separates_a_ring(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        rows.append((i, x, y, int(x * x + y * y < 3.5)))  # not separable by a line
    df = spark.createDataFrame(rows, "pid bigint, a double, b double, label int")
    p = mo.predict("svm", fit_kernel_svc(df, FEATURES), df)
    assert p.where("prediction = label").count() > 540
    assert p.where("score < 0 OR score > 1").count() == 0


def test_train_evaluate_save_load(spark, cloud):
    s = mo.ModelSettings(trees=10, enabled=("random_forest", "isolation_forest", "one_class_svm", "logistic_regression"))
    models, table = mo.train_all(cloud, FEATURES, s)
    f1 = {r.model: r.f1_score for r in table.collect()}
    info = {r.model: r.auc_roc for r in table.collect()}
    assert info["random_forest"] > 0.99 and info["isolation_forest"] is None
    assert f1["random_forest"] > 0.97 and f1["isolation_forest"] > 0.85
    assert mo.auc("random_forest", models["random_forest"], cloud) > 0.99
    path = scratch_path(spark, "test-models")
    mo.save_models(spark, models, table, path)
    back, metrics = mo.load_models(spark, path)
    assert set(back) == set(models) and metrics.count() == 4
    a, b = (mo.votes(m, cloud).select("pid", "model", "vote") for m in (models, back))
    assert a.exceptAll(b).count() == 0


def test_grid_search_marks_one_winner(cloud):
    _, table = mo.grid_search(cloud, FEATURES, {"maxDepth": [1, 4]}, folds=3, s=mo.ModelSettings(trees=5))
    rows = table.collect()
    assert sum(r.best for r in rows) == 1 and all(0 <= r.cv_f1 <= 1 for r in rows)
    assert max(rows, key=lambda r: r.cv_f1).best


def test_confidence_of_one_class_models_is_inverted(cloud):
    model = fit_isolation_forest(cloud, FEATURES, trees=20)
    p = mo.predict("isolation_forest", model, cloud)
    assert p.where("prediction = 1 AND model_confidence <= 0.5").count() == 0
    assert p.where("prediction = 0 AND model_confidence > 0.5").count() == 0


def test_forest_scores_equal_a_plain_walk():
    """All rows of a block go down together; each score is that of its own way, missing values go right."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4))
    x[::9, 1] = np.nan
    names = ("feature", "split", "left", "right", "size")
    grown = [_grow(x[~np.isnan(x[:, 1])][t::40], np.random.default_rng(t), 4) for t in range(6)] + [_grow(x[:1], rng, 4)]
    model = IsolationForestModel([], [dict(zip(names, map(np.array, zip(*nodes)))) for nodes in grown], 16)

    def length(nodes, row):
        at, depth = 0, 0
        while nodes[at][0] >= 0:
            f, cut, left, right, _ = nodes[at]
            at, depth = (left if row[f] <= cut else right), depth + 1
        return depth + float(_average_path(nodes[at][4]))

    want = [2.0 ** (-sum(length(nodes, row) for nodes in grown) / len(grown) / float(_average_path(16))) for row in x]
    walk = model.walk()
    assert np.allclose(model.scores(x, walk, block=128), want) and np.array_equal(model.scores(x), model.scores(x, walk, block=128))
    assert "walk" not in model.__dict__ and model.scores(x[:0]).shape == (0,)


def test_sums_of_many_tasks_are_added_in_groups(spark, many_partitions):
    df = spark.range(0, 3000, numPartitions=90).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") > 0, 1).alias("b"))
    packed = blocks(df, ["a", "b"])
    parts = packed.mapInArrow(lambda it: (_packed(np.nansum(np.frombuffer(v.as_buffer()).reshape(-1, 2), axis=0)) for b in it for v in b.column(0)),
                              "v binary")
    assert added(parts, 90).tolist() == added(parts, 1).tolist() == [2999 * 1500.0, 2999.0]  # the null is NaN
    assert added(parts.where("false"), 1) is None
