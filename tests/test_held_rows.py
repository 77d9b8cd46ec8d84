"""Training rows are held once, whatever fits them, and without columns that no model reads."""

import pytest
from pyspark.sql import functions as F

from flowlantern.operators import models as mo


@pytest.fixture
def rows(spark):
    return spark.range(400).select(
        F.col("id").alias("pid"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        (F.col("id") % 7 > 4).cast("int").alias("label"), F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("src_ip"))


def _held(spark) -> set:
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


@pytest.fixture
def seen(spark, monkeypatch):
    """(tables cached since the start of the test, columns) at each fit."""
    others = _held(spark)
    found, fit = [], mo.train

    def train(name, df, *args):
        df.count()  # fills what is cached
        found.append((len(_held(spark) - others), df.columns))
        return fit(name, df, *args)

    monkeypatch.setattr(mo, "train", train)
    return found


def test_training_rows_are_held_once(spark, rows, seen):
    s = mo.ModelSettings(trees=2, depth=2, enabled=("random_forest",))
    table = mo.train_all(rows, ["a", "b"], s, folds=2)[1]
    assert len(seen) == 3 and all(n == 1 for n, _ in seen)
    assert all("src_ip" not in columns for _, columns in seen)
    got = table.first()
    want = mo.fold_scores(mo.split(rows)[0], ["a", "b"], ("random_forest",), 2, s).first()
    assert (got.cv_mean, got.cv_sd) == (want.cv_f1, want.cv_sd)


def test_folds_hold_rows_that_the_caller_does_not(spark, rows, seen):
    mo.fold_scores(rows, ["a", "b"], ("random_forest",), 2, mo.ModelSettings(trees=2, depth=2))
    assert [n for n, _ in seen] == [1, 1]
    kept = rows.persist()
    mo.fold_scores(kept, ["a", "b"], ("random_forest",), 2, mo.ModelSettings(trees=2, depth=2))
    assert kept.is_cached and kept.storageLevel.useMemory and [n for n, _ in seen[2:]] == [1, 1]
    kept.unpersist()
