"""Faults that only show at scale: large ids, slow averages."""

import pytest
from pyspark.sql import functions as F

from flowlantern.config import Thresholds
from flowlantern.operators import ensemble, metrics


def test_large_ids(spark):
    got = spark.range(10**12, 10**12 + 5000).select(metrics.hash_percent(F.col("id")).alias("p")).agg(F.min("p"), F.max("p"), F.avg("p")).first()
    assert 0 <= got[0] <= 3 and 97 <= got[1] <= 100 and 45 < got[2] < 55


@pytest.mark.parametrize("alpha", [0.1, 0.01, 0.001])
def test_moving_average_uses_all_rows(spark, alpha):
    df = spark.range(5000).select((F.col("id") * 70_000).alias("ts_us"), F.col("id").alias("pid"), F.lit(1.0).alias("x"))
    got = ensemble.moving_average(df, ["x"], Thresholds(ema_alpha=alpha)).first()["x"]
    assert abs(got - (1 - (1 - alpha) ** 5000)) < 1e-9
