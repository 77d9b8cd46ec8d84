"""Logistic fit by Newton steps: few passes, the optimum of the estimator's objective, odd labels."""

import random

import numpy as np
import pytest

from flowlantern.operators import models as mo

FEATURES = ["a", "b", "c", "d"]


def _flat(spark, n=600):
    """Noisy classes over columns of very different sizes that nearly depend on each other."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, 1e4 * b, a + 1e-3 * rng.gauss(0, 1), 1e4 * b + 10 * rng.gauss(0, 1) + 50 * a, int(a + b + rng.gauss(0, 0.3) > 0)))
    return spark.createDataFrame(rows, "pid bigint, a double, b double, c double, d double, label int")


def _jobs(spark, make):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    try:
        made = make()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return made, len(sc.statusTracker().getJobIdsForGroup("counted"))


def _objective(model, df, features):
    rows = np.array(df.select(*features, "label").collect(), float)
    fit = model.stages[-1]
    w = np.array(fit.coefficients)
    m = rows[:, :-1] @ w + fit.intercept
    return (np.logaddexp(0, m) - rows[:, -1] * m).mean() + w @ w / 2 / len(rows)


def test_logistic_fit_of_dependent_columns_needs_few_passes(spark):
    df = _flat(spark).persist()
    model, jobs = _jobs(spark, lambda: mo.train("logistic_regression", df, FEATURES))
    plain = mo.logistic_regression(FEATURES, df.count()).fit(mo._labelled(df))
    assert jobs < 22  # 43 before
    assert _objective(model, df, FEATURES) <= _objective(plain, df, FEATURES) + 1e-9
    p, q = (mo.predict("logistic_regression", m, df).orderBy("pid").select("prediction", "score").collect() for m in (model, plain))
    assert sum(a.prediction != b.prediction for a, b in zip(p, q)) <= 3
    assert max(abs(a.score - b.score) for a, b in zip(p, q)) < 0.05
    df.unpersist()


def test_logistic_fit_is_that_of_the_estimator(spark):
    df = _flat(spark)
    got, want = mo.train("logistic_regression", df, ["a"]).stages[-1], mo.logistic_regression(["a"], 600).fit(mo._labelled(df)).stages[-1]
    assert got.coefficients[0] == pytest.approx(want.coefficients[0], abs=1e-3) and got.intercept == pytest.approx(want.intercept, abs=1e-3)
    assert got.getFeaturesCol() == want.getFeaturesCol() and got.getRegParam() == want.getRegParam()
    again = mo.train("logistic_regression", df.repartition(7), FEATURES).stages[-1]
    assert np.allclose(again.coefficients, mo.train("logistic_regression", df, FEATURES).stages[-1].coefficients, rtol=1e-5)


@pytest.mark.parametrize("label", ["0", "1", "pid % 3"])
def test_logistic_fit_leaves_other_labels_to_the_estimator(spark, label):
    df = _flat(spark, 60).selectExpr("pid", "a", "b", f"cast({label} as int) label")
    got, want = mo.train("logistic_regression", df, ["a"]), mo.logistic_regression(["a"], 60).fit(mo._labelled(df))
    a, b = (m.transform(df).orderBy("pid").select("prediction").collect() for m in (got, want))
    assert a == b


def test_missing_features_are_no_rows_to_fit_on(spark):
    df = _flat(spark, 60).selectExpr("pid", "if(pid < 5, null, a) a", "label")
    with pytest.raises(Exception, match="must not be null"):
        mo.train("logistic_regression", df, ["a"])


def test_logistic_bound_of_steps_is_reported(spark):
    with pytest.warns(UserWarning, match="stopped after 1 steps"):
        mo.train("logistic_regression", _flat(spark), FEATURES, mo.ModelSettings(logistic_iterations=1))
