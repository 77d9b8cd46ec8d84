"""Kernel SVC by Newton steps on the smoothed hinge: the least objective, odd labels."""

import random

import numpy as np
import pyarrow as pa
import pytest

from flowlantern.operators import kernel, models as mo


def _svc_objective(model, rows):
    y = 2 * rows[:, -1] - 1
    slack = 1 - y * (model.fmap.of(rows[:, :-1]) @ model.weights + model.intercept)
    return np.maximum(slack, 0).mean() + model.weights @ model.weights / 2 / len(rows)


def test_kernel_svc_settles_at_the_least_objective(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        rows.append((i, x, y, int(x * x + y * y < 3.5 + rng.gauss(0, 0.5))))
    df = spark.createDataFrame(rows, "pid bigint, a double, b double, label int").persist()
    cells = np.array([r[1:] for r in rows])
    model = mo.train("svm", df, ["a", "b"])
    assert model.converged and model.passes < 60
    best, spread = kernel.fit_kernel_svc(df, ["a", "b"], tolerance=1e-4, iterations=400), mo.train("svm", df.repartition(5), ["a", "b"])
    least = _svc_objective(best, cells)
    assert least <= _svc_objective(model, cells) <= 1.003 * least
    assert np.allclose(spread.weights, model.weights, atol=1e-3)
    df.unpersist()


def test_kernel_svc_of_odd_labels(spark):
    df = spark.range(60).selectExpr("id pid", "id % 7 / 3.0D a", "0 label")
    with pytest.raises(Exception, match="must not be null"):
        mo.train("svm", df.selectExpr("pid", "if(pid < 5, null, a) a", "cast(pid % 2 as int) label"), ["a"])
    one = mo.train("svm", df.selectExpr("pid", "a", "1 label"), ["a"])
    assert {r.prediction for r in mo.predict("svm", one, df).collect()} == {1}
    for label in ("0", "pid % 3", "if(pid < 5, null, 1)"):
        with pytest.raises(ValueError, match="labels 0 and 1"):
            mo.train("svm", df.selectExpr("pid", "a", f"cast({label} as int) label"), ["a"])


def test_smoothed_hinge_has_its_optimality():
    slack, mu = np.array([-3.0, -1e-3, 0.0, 1e-3, 4.0]), 0.01
    value, xi, rest = kernel.smoothed_hinge(slack, mu)
    assert np.allclose(mu / xi + mu / rest, 1) and np.allclose(xi - rest, slack)
    assert np.allclose(value, xi - mu * np.log(xi) - mu * np.log(rest))


def test_blocks_are_worked_on_in_slices(spark):
    df = spark.range(5000).coalesce(1).selectExpr("cast(id as double) a", "cast(id % 3 as double) b")
    packed = pa.chunked_array([pa.array([r.v for r in kernel.blocks(df, ["a", "b"]).collect()], pa.binary())]).combine_chunks()
    parts = list(kernel.slices(packed, 2))
    assert max(len(p) for p in parts) == kernel.SLICE and np.concatenate(parts)[:, 0].tolist() == list(range(5000))
    assert np.concatenate([y for _, y in kernel.labelled_rows(packed, ["a"])]).tolist() == [i % 3 for i in range(5000)]
