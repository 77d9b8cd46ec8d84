"""Votes of several models combined into verdicts, and reports over the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions.net import ratio, round6

# ``votes``: one row per (pid, model) with ``vote`` 0/1. All three schemes are one aggregation on the row id.


def majority_vote(votes: DataFrame) -> DataFrame:
    """Anomaly if more than half of the models say so; confidence and score are the share of votes."""
    share = F.sum("vote") / F.count("*")
    return votes.groupBy("pid").agg(
        (F.sum("vote") * 2 > F.count("*")).alias("is_anomaly"), share.alias("anomaly_score"), share.alias("confidence"))


def weighted_vote(votes: DataFrame, model_f1: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Votes weighted by each model's F1 (1 if unknown). ``model_f1`` has one row per model, so it is broadcast."""
    w = F.coalesce("f1", F.lit(1.0))
    share = F.sum(w * F.col("vote")) / F.sum(w)
    g = votes.join(F.broadcast(model_f1), "model", "left").groupBy("pid").agg(share.alias("anomaly_score"))
    return g.select("pid", (F.col("anomaly_score") > th.weighted_threshold).alias("is_anomaly"), "anomaly_score",
                    F.col("anomaly_score").alias("confidence"))


def consensus_vote(votes: DataFrame) -> DataFrame:
    """Anomaly only if all models agree on it; confidence 1 when unanimous either way, else 0."""
    s, n = F.sum("vote"), F.count("*")
    return votes.groupBy("pid").agg(
        (s == n).alias("is_anomaly"), (s / n).alias("anomaly_score"),
        F.when((s == n) | (s == 0), 1.0).otherwise(0.0).alias("confidence"))


def detections(votes: DataFrame, samples: DataFrame, method: str = "majority_vote", model_f1: DataFrame | None = None,
               th: Thresholds = DEFAULTS) -> DataFrame:
    """Result rows: verdict, per-model predictions and the addresses of the sample the verdict is about.

    ``samples`` has pid, ts_us, src_ip, dst_ip. Votes per sample are as many as models, so the map is small.
    """
    if method == "weighted_vote":
        verdict = weighted_vote(votes, model_f1, th)
    else:
        verdict = {"majority_vote": majority_vote, "consensus_vote": consensus_vote}[method](votes)
    conf = F.col("model_confidence") if "model_confidence" in votes.columns else F.lit(1.0)
    preds = votes.groupBy("pid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "model", F.struct(F.col("vote").alias("prediction"), conf.alias("confidence"),
                          (F.col("vote") == 1).alias("is_anomaly")))))).alias("predictions"))
    return verdict.join(preds, "pid").join(samples, "pid").select(
        "pid", "ts_us", "is_anomaly", "anomaly_score", "confidence", "predictions",
        F.lit(method).alias("detection_method"),
        F.create_map(F.lit("source_ip"), "src_ip", F.lit("target_ip"), "dst_ip").alias("metadata"))


def wide_detections(voted: DataFrame, method: str = "majority_vote", model_f1: dict[str, float] | None = None,
                    th: Thresholds = DEFAULTS) -> DataFrame:
    """``detections`` of rows that carry all their votes in an array ``votes`` of (model, vote, model_confidence): a projection, no shuffle.

    ``voted`` also has pid, ts_us, src_ip and dst_ip. ``model_f1`` has one entry for each model; unknown models and none weigh 1.
    """
    add = lambda f: F.aggregate("votes", F.lit(0.0), lambda a, v: a + f(v))
    yes, n = add(lambda v: v["vote"].cast("double")), F.size("votes")
    share = yes / n
    if method == "weighted_vote":
        known = [x for m, f1 in sorted((model_f1 or {}).items()) for x in (F.lit(m), F.lit(f1).cast("double"))]
        weight = lambda v: F.coalesce(F.create_map(*known)[v["model"]], F.lit(1.0)) if known else F.lit(1.0)
        share = ratio(add(lambda v: weight(v) * v["vote"]), add(weight))
        anomaly, confidence = share > th.weighted_threshold, share
    elif method == "majority_vote":
        anomaly, confidence = yes * 2 > n, share
    elif method == "consensus_vote":
        anomaly, confidence = yes == n, F.when((yes == n) | (yes == 0), 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown method {method}")
    entry = lambda v: F.struct(v["model"].alias("key"), F.struct(
        v["vote"].alias("prediction"), v["model_confidence"].alias("confidence"), (v["vote"] == 1).alias("is_anomaly")).alias("value"))
    return voted.select(
        "pid", "ts_us", anomaly.alias("is_anomaly"), share.alias("anomaly_score"), confidence.alias("confidence"),
        F.map_from_entries(F.array_sort(F.transform("votes", entry))).alias("predictions"), F.lit(method).alias("detection_method"),
        F.create_map(F.lit("source_ip"), "src_ip", F.lit("target_ip"), "dst_ip").alias("metadata"))


def _moving_averages(df: DataFrame, cols: list[str], alpha: float, counts: dict[str, Column]) -> DataFrame:
    """One row: exponential moving averages from 0 of ``cols`` in (ts_us, pid) order, and the sums ``counts``.

    A range of rows maps an average x to (1 - a) ** n * x + value. Rows are ranged newest first, so each range gives its (n, value) from the
    row numbers of its task in one hash aggregate, and the maps, one row for each range, are composed in order.
    """
    rest = 1.0 - alpha
    rows = df.select("ts_us", "pid", *cols, *[c.alias(n) for n, c in counts.items()])
    order = [F.desc("ts_us"), F.desc("pid")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id() % F.lit(1 << 33)  # row numbers of a task start at 0 in the lower 33 bits
    rows = rows.select("*", F.spark_partition_id().alias("part"), (F.lit(alpha) * F.pow(F.lit(rest), place)).alias("weight"))
    ranges = rows.groupBy("part").agg(
        F.count("*").alias("n"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols], *[F.sum(n).alias(n) for n in counts])
    start = F.struct(F.lit(1.0).alias("decay"), *[F.lit(0.0).alias(c) for c in cols])
    ema = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "n", *cols))), start, lambda a, r: F.struct(
        (a["decay"] * F.pow(F.lit(rest), r["n"])).alias("decay"),
        *[(a[c] + a["decay"] * F.coalesce(r[c], F.lit(0.0))).alias(c) for c in cols]))
    return ranges.agg(ema.alias("ema"), *[F.sum(n).alias(n) for n in counts])


def moving_average(df: DataFrame, cols: list[str], th: Thresholds = DEFAULTS) -> DataFrame:
    """Exponential moving averages from 0, over all rows in (ts_us, pid) order, as one row; null without rows."""
    out = _moving_averages(df, cols, th.ema_alpha, {"rows": F.lit(1)})
    return out.select(*[F.when(F.col("rows") > 0, F.col(f"ema.{c}")).alias(c) for c in cols])


def detection_stats(det: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Counts, anomaly rate and moving averages from one pass over the detections."""
    out = _moving_averages(det, ["confidence", "anomaly_score"], th.ema_alpha,
                           {"total": F.lit(1), "hits": F.when(F.col("is_anomaly"), 1).otherwise(0)})
    n, k = F.coalesce("total", F.lit(0)), F.coalesce("hits", F.lit(0))
    return out.select(
        n.alias("total_samples"), k.alias("anomaly_count"), (n - k).alias("normal_count"), round6(ratio(k, n)).alias("anomaly_rate"),
        *[round6(F.when(n > 0, F.col(f"ema.{c}"))).alias(f"avg_{c}") for c in ("confidence", "anomaly_score")])


def anomaly_trends(det: DataFrame, window_us: int, as_of: int | None = None) -> DataFrame:
    """Counts and rates over the trailing window, and whether its second half differs from the first."""
    now = F.lit(as_of) if as_of is not None else det.agg(F.max("ts_us")).scalar()
    d = det.withColumn("as_of", now).where(F.col("ts_us") >= F.col("as_of") - window_us)
    late = F.col("ts_us") >= F.col("as_of") - window_us / 2
    hit = F.col("is_anomaly")
    g = d.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("k"),
        F.count_if(~late).alias("n1"), F.count_if(~late & hit).alias("k1"),
        F.count_if(late).alias("n2"), F.count_if(late & hit).alias("k2"),
        F.avg("confidence").alias("conf"), F.avg(F.when(hit, F.col("anomaly_score"))).alias("score"))
    r1, r2 = ratio(F.col("k1"), F.col("n1")), ratio(F.col("k2"), F.col("n2"))
    return g.select(
        F.col("n").alias("total_detections"), F.col("k").alias("anomaly_count"),
        round6(ratio(F.col("k"), F.col("n"))).alias("anomaly_rate"),
        round6(F.col("k") * 3600.0 / (window_us / SECOND)).alias("hourly_rate"),
        F.when(r2 > r1 * 1.2, "increasing").when(r2 < r1 * 0.8, "decreasing").otherwise("stable").alias("trend"),
        round6(r1).alias("first_half_rate"), round6(r2).alias("second_half_rate"),
        round6(F.coalesce("conf", F.lit(0.0))).alias("avg_confidence"),
        round6(F.coalesce("score", F.lit(0.0))).alias("avg_anomaly_score"))


def recent_detections(det: DataFrame, n: int = 100, anomalies_only: bool = False) -> DataFrame:
    out = det.orderBy(F.desc("ts_us"), F.desc("pid")).limit(n)
    return out.where("is_anomaly") if anomalies_only else out


def model_agreement(det: DataFrame) -> DataFrame:
    """Share of rows where a model agrees with the verdict, and how often it was used."""
    rows = det.select("is_anomaly", F.explode("predictions").alias("model", "p"))
    return rows.groupBy("model").agg(
        F.count("*").alias("uses"),
        round6(F.avg((F.col("p.is_anomaly") == F.col("is_anomaly")).cast("double"))).alias("agreement"))
