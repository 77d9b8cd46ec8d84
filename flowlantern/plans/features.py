"""Feature tables, scaling, selection, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlantern.functions.net import round6
from flowlantern.operators import features as ft, metrics as me
from flowlantern.plans.alerts import r6
from flowlantern.plans.base import query
from flowlantern.plans.flows import FLOW_ROWS, FLOW_WINDOWS, _r, rounded, stored_flows, window_cte, window_rows
from flowlantern.sources import fixture as fx

ML_FLOW = """
, mf AS (SELECT * REPLACE (CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2 ELSE 3 END AS protocol), flow_pid AS pid, 0 AS ttl,
  CASE WHEN src_port = 0 THEN 0 WHEN src_port < 1024 THEN 1 WHEN src_port < 49152 THEN 2 ELSE 3 END AS src_port_category,
  CASE WHEN dst_port = 0 THEN 0 WHEN dst_port < 1024 THEN 1 WHEN dst_port < 49152 THEN 2 ELSE 3 END AS dst_port_category,
  src_to_dst_packets > dst_to_src_packets AS direction_bias, duration > 30 AS is_long_duration, avg_packet_size > 1000 AS has_large_packets,
  packet_count > 100 AS has_high_packet_count FROM f),
ml AS (SELECT pid, label, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ft.FLOW_FEATURES) + " FROM mf)"


def ml_flows(spark, d):
    return ft.ml_flow_features(stored_flows(spark, d))


@query("ml_flow_features", FLOW_ROWS + ML_FLOW + f" SELECT pid, label, {_r(*ft.FLOW_FEATURES)} FROM ml", ("packets",), recursive=True)
def ml_flow_features(spark, d):
    return rounded(ml_flows(spark, d), ft.FLOW_FEATURES)


@query("ml_window_features", FLOW_ROWS + window_cte((5, 50), (20000, 200000)) + FLOW_WINDOWS + f"""
, z AS (SELECT *, CASE WHEN hour(make_timestamp(window_us)) BETWEEN 6 AND 11 THEN 0 WHEN hour(make_timestamp(window_us)) BETWEEN 12 AND 17 THEN 1
  WHEN hour(make_timestamp(window_us)) >= 18 THEN 2 ELSE 3 END AS time_category,
  CASE WHEN arp_ratio >= greatest(tcp_ratio, udp_ratio, icmp_ratio) THEN 3 WHEN icmp_ratio >= greatest(tcp_ratio, udp_ratio) THEN 2
    WHEN tcp_ratio >= udp_ratio THEN 0 ELSE 1 END AS dominant_protocol,
  total_packets > 1000 AS is_high_traffic, unique_sources > 100 AS has_many_sources, unique_destinations > 100 AS has_many_destinations,
  port_scan_score > 0.5 AS has_port_scan, dos_score > 0.5 AS has_dos, data_exfiltration_score > 0.5 AS has_data_exfiltration,
  unusual_protocol_score > 0.5 AS has_unusual_protocol FROM wx)
SELECT window_us, {_r(*ft.WINDOW_FEATURES)} FROM z
""", ("packets",), recursive=True)
def ml_window_features(spark, d):
    return rounded(ft.ml_window_features(window_rows(spark, d)), ft.WINDOW_FEATURES)


@query("standard_scale", FLOW_ROWS + ML_FLOW + " SELECT pid, " + ", ".join(
    f"{r6(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END')} AS {c}"
    for c in ft.FLOW_NUMERICAL) + " FROM ml", ("packets",), recursive=True)
def standard_scale(spark, d):
    df = ml_flows(spark, d).select("pid", *ft.FLOW_NUMERICAL)
    return rounded(ft.scale(df, ft.fit_standard(df, ft.FLOW_NUMERICAL)), ft.FLOW_NUMERICAL)


@query("minmax_scale", FLOW_ROWS + ML_FLOW + " SELECT pid, " + ", ".join(
    f"{r6(f'({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () > min({c}) OVER () THEN max({c}) OVER () - min({c}) OVER () ELSE 1 END')} AS {c}"
    for c in ft.FLOW_NUMERICAL) + " FROM ml", ("packets",), recursive=True)
def minmax_scale(spark, d):
    df = ml_flows(spark, d).select("pid", *ft.FLOW_NUMERICAL)
    return rounded(ft.scale(df, ft.fit_minmax(df, ft.FLOW_NUMERICAL)), ft.FLOW_NUMERICAL)


@query("online_stats", FLOW_ROWS + ML_FLOW + "\nUNION ALL ".join(
    f" SELECT '{c}' AS feature, count(*) AS n, {r6(f'avg({c})')} AS mean, floor(stddev_pop({c}) * 1e3 + 0.5) / 1e3 AS sd FROM ml"
    for c in ft.FLOW_NUMERICAL), ("packets",), recursive=True)
def online_stats(spark, d):
    """Statistics of four batches, merged. The deviation comes from sums of squares, so it is shown to 3 places."""
    parts = ft.batch_stats(ml_flows(spark, d), ft.FLOW_NUMERICAL, F.col("pid") % 4)
    return ft.merge_stats(parts).select("feature", "n", round6(F.col("mean")).alias("mean"),
                                        (F.floor(F.col("sd") * 1e3 + 0.5) / 1e3).alias("sd"))


F_SCORES = ", fs AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / nullif(sum(w) / (sum(n) - count(*)), 0) AS score FROM "
    f"(SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS w, (SELECT avg({c}) FROM ml) AS g FROM ml GROUP BY label)"
    for c in ft.FLOW_FEATURES) + ")"
_SCORE = "floor(coalesce(score, 0) * 1e3 + 0.5) / 1e3 AS score"


@query("feature_importance", FLOW_ROWS + ML_FLOW + F_SCORES + f" SELECT feature, {_SCORE} FROM fs", ("packets",), recursive=True)
def feature_importance(spark, d):
    return ft.f_scores(ml_flows(spark, d), ft.FLOW_FEATURES).withColumn("score", F.floor(F.col("score") * 1e3 + 0.5) / 1e3)


@query("select_features", FLOW_ROWS + ML_FLOW + F_SCORES + f" SELECT feature, {_SCORE} FROM fs ORDER BY coalesce(score, 0) DESC, feature LIMIT 20",
       ("packets",), recursive=True)
def select_features(spark, d):
    top = ft.top_features(ft.f_scores(ml_flows(spark, d), ft.FLOW_FEATURES))
    return top.withColumn("score", F.floor(F.col("score") * 1e3 + 0.5) / 1e3)


@query("mutual_information")
def mutual_information(spark, d):
    df = ml_flows(spark, d)
    return ft.mutual_information(df, ft.FLOW_FEATURES)


@query("dataset_metadata", FLOW_ROWS + f"""
SELECT count(*) AS samples, count(DISTINCT src_ip) AS sources, {r6('avg(duration)')} AS mean_duration,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT protocol AS k, count(*) AS n FROM f GROUP BY 1)) AS protocol_distribution,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT label AS k, count(*) AS n FROM f GROUP BY 1)) AS class_distribution FROM f
""", ("packets",), recursive=True)
def dataset_metadata(spark, d):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return ft.dataset_metadata(stored_flows(spark, d)).select(
        "samples", "sources", round6(F.col("mean_duration")).alias("mean_duration"), text("protocol_distribution"), text("class_distribution"))


# ---- splits and evaluation ----------------------------------------------------------------------
HASH = "((pid * 2654435761 % 4294967296) // 42949673)"


@query("stratified_split", f"""
SELECT label, CASE WHEN {HASH} < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(pid) AS first_pid, CAST(sum(pid) AS BIGINT) AS pid_sum
FROM packets GROUP BY 1, 2
""", ("packets",))
def stratified_split(spark, d):
    return fx.packets(spark, d).groupBy("label", F.when(me.is_train(F.col("pid")), "train").otherwise("test").alias("part")).agg(
        F.count("*").alias("rows"), F.min("pid").alias("first_pid"), F.sum("pid").alias("pid_sum"))


@query("cv_folds", f"""
SELECT label, CAST({HASH} % 5 AS INT) AS fold, count(*) AS rows, CAST(sum(pid) AS BIGINT) AS pid_sum FROM packets GROUP BY 1, 2
""", ("packets",))
def cv_folds(spark, d):
    return fx.packets(spark, d).groupBy("label", me.fold(F.col("pid")).alias("fold")).agg(
        F.count("*").alias("rows"), F.sum("pid").alias("pid_sum"))


METRIC_SQL = """
, cf AS (SELECT model, label, vote AS prediction, count(*) AS n FROM votes_fx GROUP BY 1, 2, 3),
rp AS (SELECT model, c AS class, coalesce(sum(n) FILTER (label = c), 0) AS support, coalesce(sum(n) FILTER (label = c AND prediction = c), 0) AS tp,
  coalesce(sum(n) FILTER (prediction = c), 0) AS predicted FROM cf, (VALUES (0), (1)) k(c) GROUP BY 1, 2),
rr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM rp),
rf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rr),
mm AS (SELECT model, sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
  sum(f1 * support) / sum(support) AS f1_score FROM rf GROUP BY model)
"""


def _conf(spark, d):
    return me.confusion(fx.view(spark, d, "votes_fx"), pred="vote", by=("model",))


@query("classification_metrics", METRIC_SQL + f"SELECT model, {_r(*me.METRICS)} FROM mm", ("votes_fx",))
def classification_metrics(spark, d):
    return rounded(me.weighted_metrics(_conf(spark, d), ("model",)), me.METRICS)


@query("confusion_matrix", METRIC_SQL + "SELECT * FROM cf", ("votes_fx",))
def confusion_matrix(spark, d):
    return _conf(spark, d)


@query("class_report", METRIC_SQL + f"SELECT model, class, CAST(support AS BIGINT) AS support, {_r('precision', 'recall', 'f1')} FROM rf", ("votes_fx",))
def class_report(spark, d):
    return rounded(me.class_report(_conf(spark, d), ("model",)).drop("tp"), ["precision", "recall", "f1"])


@query("roc_auc", f"""
, s AS (SELECT pid, any_value(label) AS label, sum(vote) AS score FROM votes_fx GROUP BY pid),
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score)
SELECT {r6('(SELECT sum(a.pos * b.neg * CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) FROM g a, g b) / (sum(pos) * sum(neg))')} AS auc_roc
FROM g
""", ("votes_fx",))
def roc_auc(spark, d):
    s = fx.view(spark, d, "votes_fx").groupBy("pid").agg(F.first("label").alias("label"), F.sum("vote").alias("score"))
    return rounded(me.roc_auc(s), ["auc_roc"])


@query("roc_auc_flows", FLOW_ROWS + f"""
, s AS (SELECT label, CAST(byte_count AS DOUBLE) / packet_count AS score FROM f),
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score),
c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM g)
SELECT {r6('sum(pos * (below + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg))')} AS auc_roc FROM c
""", ("packets",), recursive=True)
def roc_auc_flows(spark, d):
    """How well the mean packet size of a flow, a score with many values, ranks the attacks."""
    s = stored_flows(spark, d).select("label", (F.col("byte_count") / F.col("packet_count")).alias("score"))
    return rounded(me.roc_auc(s), ["auc_roc"])


@query("model_summary", METRIC_SQL + "\nUNION ALL ".join(
    f" SELECT '{m}' AS metric, (SELECT model FROM mm ORDER BY {m} DESC, model LIMIT 1) AS model, (SELECT {r6(f'max({m})')} FROM mm) AS value" for m in me.METRICS),
    ("votes_fx",))
def model_summary(spark, d):
    return rounded(me.model_summary(me.weighted_metrics(_conf(spark, d), ("model",))), ["value"])


@query("model_report", METRIC_SQL + """
SELECT model, printf('%s: accuracy %.4f, precision %.4f, recall %.4f, f1 %.4f', model, accuracy, precision, recall, f1_score) AS line FROM mm
""", ("votes_fx",))
def model_report(spark, d):
    return me.text_report(me.weighted_metrics(_conf(spark, d), ("model",)))
