"""Operators that work by ranges or in one projection, against plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from flowlantern.config import Thresholds
from flowlantern.operators import ensemble as en, metrics as me, models as mo
from flowlantern.plans.registry import QUERIES
from flowlantern.session import scratch_path
from flowlantern.sources import sinks


def test_auc_over_ranges(spark):
    rng = random.Random(3)
    rows = [(m, rng.choice([rng.gauss(y, 1), round(rng.gauss(y, 1), 1)]), y) for m in ("a", "b") for y in (rng.randint(0, 1) for _ in range(1500))]
    rows += [("one class", 0.5, 1), ("one class", 0.7, 1)]
    got = {r.model: r.auc_roc for r in me.roc_auc(spark.createDataFrame(rows, "model string, score double, label int"), by=("model",)).collect()}
    for m in ("a", "b"):
        pos, neg = ([s for k, s, y in rows if k == m and y == c] for c in (1, 0))
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert got[m] == pytest.approx(want, abs=1e-12)
    assert got["one class"] == 0  # no pairs
    plan = me.roc_auc(spark.createDataFrame(rows, "model string, score double, label int"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("ObjectHashAggregate")[-1]  # only the totals of ranges meet in one task


@pytest.mark.parametrize("alpha", [0.001, 0.1])
def test_moving_average_of_one_busy_second(spark, alpha):
    rng = random.Random(4)
    rows = [(5_000_000 + i % 3, i, rng.random(), i % 4 == 0) for i in range(4000)] + [(1, 9999, None, False)]
    df = spark.createDataFrame(rows, "ts_us bigint, pid bigint, confidence double, is_anomaly boolean").withColumn("anomaly_score", F.col("confidence"))
    want = 0.0
    for _, _, x, _ in sorted(rows, key=lambda r: r[:2]):
        want = (1 - alpha) * want + alpha * (x or 0.0)
    th = Thresholds(ema_alpha=alpha)
    for parts in (1, 7):
        got = en.detection_stats(df.repartition(parts), th).first()
        assert got.total_samples == 4001 and got.anomaly_count == 1000 and got.normal_count == 3001
        assert got.avg_confidence == got.avg_anomaly_score == pytest.approx(want, abs=1e-6)
        assert en.moving_average(df, ["confidence"], th).first()[0] == pytest.approx(want, abs=1e-12)


def test_stats_without_detections(spark):
    df = spark.createDataFrame([], "ts_us bigint, pid bigint, confidence double, anomaly_score double, is_anomaly boolean")
    got = en.detection_stats(df).first()
    assert (got.total_samples, got.anomaly_count, got.anomaly_rate, got.avg_confidence) == (0, 0, 0.0, None)


@pytest.mark.parametrize("method", ["majority_vote", "weighted_vote", "consensus_vote"])
def test_wide_verdicts_equal_long_ones(spark, method):
    rng = random.Random(6)
    long = spark.createDataFrame([(p, m, rng.randint(0, 1), rng.random()) for p in range(200) for m in ("x", "y", "z")],
                                 "pid bigint, model string, vote int, model_confidence double")
    samples = spark.range(200).select(F.col("id").alias("pid"), F.col("id").alias("ts_us"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"))
    f1 = {"x": 0.9, "y": 0.3}
    wide = samples.join(long.groupBy("pid").agg(F.collect_list(F.struct("model", "vote", "model_confidence")).alias("votes")), "pid")
    order = lambda df: [tuple(r) for r in df.orderBy("pid").collect()]
    for a, b in zip(order(en.wide_detections(wide, method, f1)),
                    order(en.detections(long, samples, method, spark.createDataFrame(list(f1.items()), "model string, f1 double")))):
        assert a[:3] == b[:3] and a[3:5] == pytest.approx(b[3:5]) and a[5:] == b[5:]


def test_all_models_in_one_scan(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.gauss(4 * (i % 5 == 0), 1), rng.gauss(0, 1), int(i % 5 == 0), 1, "s", "d", 0.5) for i in range(400)],
                               "pid bigint, a double, b double, label int, ts_us bigint, src_ip string, dst_ip string, kept double")
    s = mo.ModelSettings(trees=5, depth=4)
    models = {n: mo.train(n, df, ["a", "b"], s) for n in ("random_forest", "isolation_forest", "one_class_svm", "logistic_regression")}
    path = scratch_path(spark, "wide")
    df.write.parquet(path)
    rows = spark.read.parquet(path)
    voted = mo.voted(models, rows)
    assert voted.schema["label"].dataType.simpleString() == "int" and voted.columns == [*df.columns, "votes"]
    det = en.wide_detections(voted)
    plan = det._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    got = {(r.pid, r.model): r.vote for r in mo.votes(models, rows).collect()}
    assert len(got) == 1600
    for n, m in models.items():
        assert all(got[r.pid, n] == r.prediction for r in mo.predict(n, m, rows).collect())


def test_a_replayed_batch_doubles_nothing(spark):
    path = scratch_path(spark, "batches")
    for number in (0, 1, 1):
        sinks.write_batch(spark.range(10 * number, 10 * number + 10), path, number)
    assert sorted(r.id for r in sinks.read_batches(spark, path).collect()) == list(range(20))


def test_scored_stream_keeps_every_flow_once(spark):
    out = QUERIES["streaming_scoring"](spark, "/root/testdata/sf0.001")
    assert out.count() == out.select("pid").distinct().count() > 0
