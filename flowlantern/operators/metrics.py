"""Splits and evaluation, from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlantern.functions.net import ratio


def hash_percent(pid: Column) -> Column:
    """0..100, spread evenly over ids: decides splits and folds without a shuffle and the same way every run."""
    return F.floor((F.pmod(pid, F.lit(1 << 31)) * 2654435761 % 4294967296) / 42949673).cast("bigint")


def is_train(pid: Column, percent: int = 80) -> Column:
    """Independent of the label, so every class is split in the same proportion in expectation."""
    return hash_percent(pid) < percent


def fold(pid: Column, folds: int = 5) -> Column:
    return (hash_percent(pid) % folds).cast("int")


def confusion(preds: DataFrame, label: str = "label", pred: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    return preds.groupBy(*by, F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction")).agg(
        F.count("*").alias("n"))


def class_report(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 on zero division."""
    actual = conf.groupBy(*by, F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(*by, F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    r = actual.join(predicted, [*by, "class"], "left")
    p, c = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return r.select(*by, "class", "support", "tp", p.alias("precision"), c.alias("recall"), ratio(2 * p * c, p + c).alias("f1"))


def weighted_metrics(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    w = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return class_report(conf, by).groupBy(*by).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[w(c).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))])


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by the rank-sum with ties.

    Scores are first counted per distinct value; few values (votes) then make few rows, and continuous scores are spread by ranges.
    A range holds its own rank-sum; what lies below it is carried from the totals of the ranges before, one small row each.
    """
    per = scored.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranged = per.repartitionByRange(*by, score).withColumn("part", F.spark_partition_id())
    below = F.sum("neg").over(Window.partitionBy(*by, "part").orderBy(score)) - F.col("neg")
    pairs = F.col("pos").cast("double") * (below + F.col("neg") * 0.5)
    ranges = ranged.withColumn("pairs", pairs).groupBy(*by, "part").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    start = F.struct(*[F.lit(0).cast(t).alias(c) for c, t in (("pos", "bigint"), ("neg", "bigint"), ("pairs", "double"))])
    carried = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "pos", "neg", "pairs"))), start, lambda a, r: F.struct(
        (a["pos"] + r["pos"]).alias("pos"), (a["neg"] + r["neg"]).alias("neg"),
        (a["pairs"] + r["pairs"] + r["pos"].cast("double") * a["neg"]).alias("pairs")))
    total = ranges.groupBy(*by).agg(carried.alias("t"))
    return total.select(*by, ratio(F.col("t.pairs"), F.col("t.pos").cast("double") * F.col("t.neg")).alias("auc_roc"))


METRICS = ["accuracy", "precision", "recall", "f1_score"]


def model_summary(metrics: DataFrame) -> DataFrame:
    """Best model per metric (first name on ties), from one row per model."""
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")
    best = F.min(F.struct((-F.col("x.value")).alias("neg"), F.col("model").alias("model")))
    return metrics.select("model", x).groupBy("x.metric").agg(best.alias("b")).select(
        "metric", F.col("b.model").alias("model"), (-F.col("b.neg")).alias("value"))


def text_report(metrics: DataFrame) -> DataFrame:
    """One line per model; ``cv_mean`` and ``cv_sd`` are shown where present."""
    cv = F.lit("")
    if "cv_mean" in metrics.columns:
        cv = F.when(F.col("cv_mean").isNotNull(), F.format_string(", cv %.4f +/- %.4f", "cv_mean", "cv_sd")).otherwise("")
    return metrics.select("model", F.concat(F.format_string(
        "%s: accuracy %.4f, precision %.4f, recall %.4f, f1 %.4f", "model", *METRICS), cv).alias("line"))
