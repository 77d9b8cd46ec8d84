"""Every registered query with an oracle equals it; the others return rows with a stable schema."""

import os

import pytest
from compare import connect, diff

from flowlantern.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"grid_search", "one_class_search", "stratified_cv", "kernel_svc", "detect_windows"}  # model fits; covered in test_models


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, con, name):
    rows, err = diff(QUERIES[name](spark, SF), ORACLES[name], con)
    assert err is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in SLOW])
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
