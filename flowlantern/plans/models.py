"""Models: training, tuning, persistence, detection. Checked by row counts and by tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlantern.config import SCALED
from flowlantern.operators import ensemble as en, features as ft, flows as fl, metrics as me, models as mo, windows as win
from flowlantern.plans.base import once, query
from flowlantern.plans.flows import stored_flows
from flowlantern.session import scratch_path
from flowlantern.sources import fixture as fx

def flow_table(spark, d):
    """Model features of the stored flows, with time and addresses."""
    return ft.ml_flow_features(stored_flows(spark, d), (F.col("end_us").alias("ts_us"), F.col("src_ip"), F.col("dst_ip")))


def trained(spark, d):
    return once(spark, d, "models", lambda: mo.train_all(flow_table(spark, d), ft.FLOW_FEATURES, folds=5))


def _one(spark, d, name):
    models = trained(spark, d)[0]
    if name in models:
        return models[name]
    return once(spark, d, name, lambda: mo.train(name, mo.split(flow_table(spark, d))[0], ft.FLOW_FEATURES))


def _predictions(name):
    def run(spark, d):
        m = _one(spark, d, name)
        return mo.predict(name, m, flow_table(spark, d)).select("pid", "label", "prediction", "model_confidence", "score")
    return run


for _name, _query in (("random_forest", "random_forest"), ("isolation_forest", "isolation_forest"),
                      ("one_class_svm", "one_class_svm"), ("svm", "kernel_svc"), ("logistic_regression", "logistic_regression")):
    query(_query)(_predictions(_name))


@query("train_all")
def train_all(spark, d):
    return trained(spark, d)[1]


@query("stratified_cv")
def stratified_cv(spark, d):
    """Weighted F1 of all models on each of five folds of the training rows, with mean and sd."""
    return mo.fold_scores(mo.split(flow_table(spark, d))[0], ft.FLOW_FEATURES, (*mo.ModelSettings().enabled, "svm", "logistic_regression"))


@query("grid_search")
def grid_search(spark, d):
    """The forest at its default settings over depths up to the default one; the original leaves the grid to its caller."""
    return mo.grid_search(flow_table(spark, d), ft.FLOW_FEATURES, {"maxDepth": [3, 6, 10]})[1]


@query("one_class_search")
def one_class_search(spark, d):
    """Contamination of the isolation forest, over the folds that all searches share."""
    return mo.grid_search(flow_table(spark, d), ft.FLOW_FEATURES, {"contamination": [0.05, 0.1]}, "isolation_forest")[1]


@query("trained_report")
def trained_report(spark, d):
    """One line for each trained model, with mean and sd over its folds where it has them."""
    return me.text_report(trained(spark, d)[1])


@query("save_load_models")
def save_load_models(spark, d):
    """Predictions of the models after a round trip through storage."""
    models, table = trained(spark, d)
    path = scratch_path(spark, "models")
    mo.save_models(spark, models, table, path)
    back, metrics = mo.load_models(spark, path)
    return mo.votes(back, flow_table(spark, d)).groupBy("model").agg(
        F.count("*").alias("rows"), F.sum("vote").alias("anomalies")).join(metrics, "model")


@query("model_votes")
def model_votes(spark, d):
    return mo.votes(trained(spark, d)[0], flow_table(spark, d))


@query("detect_flows")
def detect_flows(spark, d):
    """All models in one projection over the flows, weighted by their F1; nothing is shuffled."""
    models, metrics = trained(spark, d)
    f1 = {r.model: r.f1_score for r in metrics.select("model", "f1_score").collect()}  # one row for each model
    det = en.wide_detections(mo.voted(models, flow_table(spark, d)), "weighted_vote", f1)
    return det.select("pid", "ts_us", "is_anomaly", "anomaly_score", "confidence", F.col("metadata")["source_ip"].alias("source_ip"))


@query("detect_windows")
def detect_windows(spark, d):
    """Windows judged by one-class models trained on windows (no window has a label of its own)."""
    p = fx.packets(spark, d)
    path = scratch_path(spark, "window-features")
    w = win.window_features(p, fl.flows(fl.flow_packets(p)), SCALED)
    ft.ml_window_features(w).withColumnRenamed("window_us", "pid").withColumn("label", F.lit(0)).write.parquet(path)
    df = spark.read.parquet(path)
    names = ("isolation_forest", "one_class_svm")
    models = {n: mo.train(n, df, ft.WINDOW_FEATURES) for n in names}
    return en.consensus_vote(mo.votes(models, df)).withColumnRenamed("pid", "window_us")
