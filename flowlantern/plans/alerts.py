"""Verdicts, alerts, notifications."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND
from flowlantern.functions.net import round6
from flowlantern.operators import alerts as al, ensemble as en, notify as no
from flowlantern.plans import rules as rule_plans
from flowlantern.plans.base import query
from flowlantern.session import scratch_path
from flowlantern.sources import fixture as fx, sinks


def r6(expr: str) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5) / 1e6"


# ---- verdicts -----------------------------------------------------------------------------------
MODEL_F1 = [("random_forest", 0.95), ("isolation_forest", 0.80), ("one_class_svm", 0.60)]
VERDICT = """
, v AS (SELECT pid, sum(vote) AS s, count(*) AS n FROM votes_fx GROUP BY pid),
det AS (SELECT p.pid, ts_us, s * 2 > n AS is_anomaly, s / n AS anomaly_score, s / n AS confidence, src_ip, dst_ip
  FROM v JOIN packets p ON p.pid = v.pid)
"""


def votes(spark, d):
    return fx.view(spark, d, "votes_fx")


def model_f1(spark):
    return spark.createDataFrame(MODEL_F1, "model string, f1 double")


def detections(spark, d):
    return en.detections(votes(spark, d), fx.packets(spark, d).select("pid", "ts_us", "src_ip", "dst_ip"))


def _verdict(df):
    return df.select("pid", "is_anomaly", round6(F.col("anomaly_score")).alias("anomaly_score"),
                     round6(F.col("confidence")).alias("confidence"))


@query("majority_vote", f"""
SELECT pid, sum(vote) * 2 > count(*) AS is_anomaly, {r6('sum(vote) / count(*)')} AS anomaly_score,
  {r6('sum(vote) / count(*)')} AS confidence FROM votes_fx GROUP BY pid
""", ("votes_fx",))
def majority_vote(spark, d):
    return _verdict(en.majority_vote(votes(spark, d)))


@query("weighted_vote", f"""
, w AS (SELECT pid, sum(vote * f1) / sum(f1) AS share FROM votes_fx JOIN (VALUES ('random_forest', 0.95::DOUBLE),
  ('isolation_forest', 0.80::DOUBLE), ('one_class_svm', 0.60::DOUBLE)) m(model, f1) USING (model) GROUP BY pid)
SELECT pid, share > 0.7 AS is_anomaly, {r6('share')} AS anomaly_score, {r6('share')} AS confidence FROM w
""", ("votes_fx",))
def weighted_vote(spark, d):
    return _verdict(en.weighted_vote(votes(spark, d), model_f1(spark)))


@query("consensus_vote", f"""
SELECT pid, bool_and(vote = 1) AS is_anomaly, {r6('avg(vote)')} AS anomaly_score,
  CASE WHEN count(DISTINCT vote) = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM votes_fx GROUP BY pid
""", ("votes_fx",))
def consensus_vote(spark, d):
    return _verdict(en.consensus_vote(votes(spark, d)))


@query("detection_stats", VERDICT + f"""
, o AS (SELECT *, row_number() OVER (ORDER BY ts_us DESC, pid DESC) - 1 AS age FROM det)
SELECT count(*) AS total_samples, count(*) FILTER (is_anomaly) AS anomaly_count, count(*) FILTER (NOT is_anomaly) AS normal_count,
  {r6('count(*) FILTER (is_anomaly) / count(*)')} AS anomaly_rate,
  {r6('sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * confidence)')} AS avg_confidence,
  {r6('sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * anomaly_score)')} AS avg_anomaly_score FROM o
""", ("packets", "votes_fx"))
def detection_stats(spark, d):
    return en.detection_stats(detections(spark, d))


@query("anomaly_trends", VERDICT + f"""
, t AS (SELECT max(ts_us) AS now FROM det),
h AS (SELECT det.*, ts_us >= now - 600000000 AS late FROM det, t WHERE ts_us >= now - 1200000000),
g AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS k, avg(CAST(is_anomaly AS INT)) FILTER (NOT late) AS r1,
  avg(CAST(is_anomaly AS INT)) FILTER (late) AS r2, avg(confidence) AS c, avg(anomaly_score) FILTER (is_anomaly) AS s FROM h)
SELECT n AS total_detections, k AS anomaly_count, {r6('k / n')} AS anomaly_rate, {r6('k * 3600.0::DOUBLE / 1200')} AS hourly_rate,
  CASE WHEN r2 > r1 * 1.2 THEN 'increasing' WHEN r2 < r1 * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend,
  {r6('r1')} AS first_half_rate, {r6('r2')} AS second_half_rate, {r6('c')} AS avg_confidence, {r6('s')} AS avg_anomaly_score
FROM g
""", ("packets", "votes_fx"))
def anomaly_trends(spark, d):
    return en.anomaly_trends(detections(spark, d), 1200 * SECOND)


@query("recent_detections", VERDICT + f"""
SELECT pid, ts_us, {r6('confidence')} AS confidence FROM (SELECT * FROM det ORDER BY ts_us DESC, pid DESC LIMIT 500) WHERE is_anomaly
""", ("packets", "votes_fx"))
def recent_detections(spark, d):
    return en.recent_detections(detections(spark, d), 500, True).select("pid", "ts_us", round6(F.col("confidence")).alias("confidence"))


@query("model_agreement", VERDICT + f"""
SELECT model, count(*) AS uses, {r6('avg(CASE WHEN (vote = 1) = is_anomaly THEN 1.0::DOUBLE ELSE 0 END)')} AS agreement
FROM votes_fx JOIN det USING (pid) GROUP BY model
""", ("packets", "votes_fx"))
def model_agreement(spark, d):
    return en.model_agreement(detections(spark, d))


@query("export_detections", VERDICT + f"""
, x AS (SELECT pid, max(CASE WHEN model = 'random_forest' THEN vote END) AS rf, max(CASE WHEN model = 'isolation_forest' THEN vote END) AS ifo,
  max(CASE WHEN model = 'one_class_svm' THEN vote END) AS oc FROM votes_fx GROUP BY pid)
SELECT strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, CAST(is_anomaly AS VARCHAR) AS is_anomaly,
  'majority_vote' AS detection_method, CAST(rf AS VARCHAR) AS random_forest_prediction, CAST(ifo AS VARCHAR) AS isolation_forest_prediction,
  CAST(oc AS VARCHAR) AS one_class_svm_prediction, src_ip AS meta_source_ip, dst_ip AS meta_target_ip
FROM det JOIN x USING (pid) WHERE ts_us BETWEEN 1704067800000000 AND 1704069000000000
""", ("packets", "votes_fx"))
def export_detections(spark, d):
    path = scratch_path(spark, "detections-csv")
    models = [m for m, _ in MODEL_F1]
    sinks.export_detections(detections(spark, d), models, path, 1704067800000000, 1704069000000000)
    return spark.read.option("header", True).csv(path).select(
        "timestamp", "is_anomaly", "detection_method", *[f"{m}_prediction" for m in models], "meta_source_ip", "meta_target_ip")


# ---- alert creation -----------------------------------------------------------------------------
def alerts_fx(spark, d):
    return fx.view(spark, d, "alerts_fx")


def manual_reports(spark, d):
    logs = fx.view(spark, d, "logs_fx").where("level = 'CRITICAL' AND source_ip IS NOT NULL")
    return logs.select(F.col("log_id").alias("report_id"), "ts_us", F.lit("HIGH").alias("priority"), "source_ip",
                       F.lit(None).cast("string").alias("target_ip"), F.lit("suspicious").alias("attack_type"),
                       F.col("message").alias("description"))


FROM_MATCHES = """SELECT sha256('match|' || pid || '|' || signature_id) AS alert_id, ts_us, severity AS priority, 'NEW' AS status,
  source_ip, target_ip, lower(category) AS attack_type, CAST(confidence AS DOUBLE) AS confidence, 'signature_engine' AS source FROM m"""
FROM_DETECTIONS = """SELECT sha256('detection|' || pid) AS alert_id, ts_us, CASE WHEN confidence >= 0.9 THEN 'CRITICAL'
  WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS priority, 'NEW' AS status, src_ip AS source_ip,
  dst_ip AS target_ip, 'anomaly_detection' AS attack_type, confidence, 'ml_detection' AS source FROM det WHERE is_anomaly"""
MANUAL = """SELECT sha256('manual|' || log_id) AS alert_id, ts_us, 'HIGH' AS priority, 'NEW' AS status, source_ip,
  CAST(NULL AS VARCHAR) AS target_ip, 'suspicious' AS attack_type, CAST(1 AS DOUBLE) AS confidence, 'manual' AS source
  FROM logs_fx WHERE level = 'CRITICAL' AND source_ip IS NOT NULL"""
_COLS = [c for c in al.ALERT_COLUMNS if c != "details"]


def _out(sql: str) -> str:
    return f"SELECT {', '.join(r6(c) + ' AS ' + c if c == 'confidence' else c for c in _COLS)} FROM ({sql})"


def _flat(df):
    return df.select(*_COLS).withColumn("confidence", round6(F.col("confidence")))


@query("alerts_from_matches", rule_plans.ALL_SQL + _out(FROM_MATCHES), ("packets",))
def alerts_from_matches(spark, d):
    return _flat(al.alerts_from_matches(rule_plans.matches(spark, d)))


@query("alerts_from_detections", VERDICT + _out(FROM_DETECTIONS), ("packets", "votes_fx"))
def alerts_from_detections(spark, d):
    return _flat(al.alerts_from_detections(detections(spark, d)))


def all_alerts(spark, d):
    return (
        al.alerts_from_matches(rule_plans.matches(spark, d))
        .unionByName(al.alerts_from_detections(detections(spark, d)))
        .unionByName(al.manual_alerts(manual_reports(spark, d)))
    )


@query("manual_alerts", rule_plans.ALL_SQL + VERDICT + _out(f"{FROM_MATCHES} UNION ALL {FROM_DETECTIONS} UNION ALL {MANUAL}"),
       ("packets", "votes_fx", "logs_fx"))
def manual_alerts(spark, d):
    """Manual reports together with the alerts of the two detectors."""
    return _flat(all_alerts(spark, d))


@query("priority_from_confidence", """
SELECT CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END
  AS priority, count(*) AS alerts, min(confidence) AS lowest FROM alerts_fx GROUP BY 1
""", ("alerts_fx",))
def priority_from_confidence(spark, d):
    return alerts_fx(spark, d).groupBy(al.priority_from_confidence(F.col("confidence")).alias("priority")).agg(
        F.count("*").alias("alerts"), F.min("confidence").alias("lowest"))


# ---- admission: the oracle recurses over the alerts of a key --------------------------------------
LIMITER = """
, a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_ip, attack_type ORDER BY ts_us, alert_id) AS rn FROM alerts_fx),
lim AS (
  SELECT source_ip, attack_type, rn, alert_id, [ts_us] AS acc, TRUE AS ok FROM a WHERE rn = 1
  UNION ALL
  SELECT source_ip, attack_type, rn, alert_id, CASE WHEN len(acc) < 10 THEN list_append(acc, ts_us) ELSE acc END, len(acc) < 10 FROM (
    SELECT a.source_ip, a.attack_type, a.rn, a.alert_id, a.ts_us, list_filter(lim.acc, lambda x: x >= a.ts_us - 60000000) AS acc
    FROM lim JOIN a ON a.source_ip = lim.source_ip AND a.attack_type = lim.attack_type AND a.rn = lim.rn + 1))
"""


def _dedup(source: str) -> str:
    return f"""
, b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_ip, attack_type, priority ORDER BY ts_us, alert_id) AS rk FROM {source}),
dd AS (
  SELECT source_ip, attack_type, priority, rk, alert_id, ts_us AS kept_us, TRUE AS keep FROM b WHERE rk = 1
  UNION ALL
  SELECT b.source_ip, b.attack_type, b.priority, b.rk, b.alert_id, CASE WHEN b.ts_us - dd.kept_us >= 60000000 THEN b.ts_us ELSE dd.kept_us END,
    b.ts_us - dd.kept_us >= 60000000
  FROM dd JOIN b ON b.source_ip = dd.source_ip AND b.attack_type = dd.attack_type AND b.priority = dd.priority AND b.rk = dd.rk + 1)
"""


@query("rate_limit", LIMITER + "SELECT alert_id, NOT ok AS rate_limited FROM lim", ("alerts_fx",), recursive=True)
def rate_limit(spark, d):
    return al.admission(alerts_fx(spark, d), dedup=False).select("alert_id", "rate_limited")


@query("dedup_alerts", _dedup("alerts_fx") + "SELECT alert_id, NOT keep AS duplicate FROM dd", ("alerts_fx",), recursive=True)
def dedup_alerts(spark, d):
    return al.admission(alerts_fx(spark, d), rate_limit=False).select("alert_id", "duplicate")


def correlation_sql(source: str) -> str:
    return f"""
, cg AS (SELECT *, coalesce(target_ip, '') AS tk, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY source_ip, attack_type, target_ip ORDER BY ts_us)
    <= CASE WHEN target_ip IS NULL THEN 90000000 ELSE 240000000 END THEN 0 ELSE 1 END AS o
  FROM {source} WHERE attack_type IN ('port_scan', 'dos', 'brute_force', 'anomaly_detection')),
cs AS (SELECT *, sum(o) OVER (PARTITION BY source_ip, attack_type, tk ORDER BY ts_us, alert_id) AS sn FROM cg),
cm AS (SELECT *, sha256('group|' || source_ip || '|' || attack_type || '|' || tk || '|' || min(ts_us) OVER (PARTITION BY source_ip, attack_type, tk, sn))
  AS correlation_id FROM cs),
grp AS (SELECT correlation_id, source_ip, attack_type, any_value(target_ip) AS target_ip, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
  count(*) AS alert_count, max(CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS severity_score
  FROM cm GROUP BY correlation_id, source_ip, attack_type)
"""


@query("alert_admission", LIMITER + ", kept1 AS (SELECT alerts_fx.* FROM alerts_fx JOIN lim USING (alert_id) WHERE ok)"
       + _dedup("kept1") + ", kept2 AS (SELECT kept1.* FROM kept1 JOIN dd USING (alert_id) WHERE keep)" + correlation_sql("kept2") + """
SELECT k.alert_id, k.ts_us, k.source_ip, k.attack_type, k.priority, cm.correlation_id FROM kept2 k LEFT JOIN cm USING (alert_id)
""", ("alerts_fx",), recursive=True)
def alert_admission(spark, d):
    """Limiter, then de-duplication, then correlation of what is left."""
    kept = al.admitted(alerts_fx(spark, d))
    return al.correlation_members(kept).select("alert_id", "ts_us", "source_ip", "attack_type", "priority", "correlation_id")


@query("correlation_groups", correlation_sql("alerts_fx") + """
SELECT *, 'Correlated ' || attack_type || ' activity' AS description, CAST(1 AS DOUBLE) AS correlation_confidence FROM grp
""", ("alerts_fx",))
def correlation_groups(spark, d):
    return al.correlation_groups(alerts_fx(spark, d))


@query("correlation_members", correlation_sql("alerts_fx") + """
SELECT f.alert_id, cm.correlation_id FROM alerts_fx f LEFT JOIN cm USING (alert_id)
""", ("alerts_fx",))
def correlation_members(spark, d):
    return al.correlation_members(alerts_fx(spark, d)).select("alert_id", "correlation_id")


@query("top_correlations", correlation_sql("alerts_fx") + """
SELECT correlation_id, alert_count, severity_score FROM grp ORDER BY severity_score DESC, alert_count DESC, first_seen_us, correlation_id LIMIT 50
""", ("alerts_fx",))
def top_correlations(spark, d):
    return al.top_correlations(al.correlation_groups(alerts_fx(spark, d))).select("correlation_id", "alert_count", "severity_score")


# ---- actions, lists, statistics -----------------------------------------------------------------
@query("alert_actions", """
SELECT alert_id, CASE WHEN alert_id % 8 = 0 THEN 'RESOLVED' WHEN alert_id % 4 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status,
  CASE WHEN alert_id % 4 = 0 THEN 'analyst' || alert_id % 3 END AS assigned_to,
  CASE WHEN alert_id % 8 = 0 THEN 'handled ' || alert_id END AS notes, CASE WHEN alert_id % 8 = 0 THEN ts_us + 120000000 END AS resolved_us
FROM alerts_fx
""", ("alerts_fx",))
def alert_actions(spark, d):
    a = alerts_fx(spark, d)
    i = F.col("alert_id")
    log = a.where(i % 4 == 0).select(
        "alert_id", F.lit("ACKNOWLEDGE").alias("action"), F.concat(F.lit("analyst"), (i % 3).cast("string")).alias("actor"),
        F.lit(None).cast("string").alias("notes"), (F.col("ts_us") + 60 * SECOND).alias("at_us"))
    log = log.unionByName(a.where(i % 8 == 0).select(
        "alert_id", F.lit("RESOLVE").alias("action"), F.lit("lead").alias("actor"),
        F.concat(F.lit("handled "), i.cast("string")).alias("notes"), (F.col("ts_us") + 120 * SECOND).alias("at_us")))
    return al.apply_actions(a, log).select("alert_id", "status", "assigned_to", "notes", "resolved_us")


@query("list_alerts", """
SELECT alert_id, ts_us, source_ip, attack_type FROM alerts_fx WHERE status = 'NEW' AND priority = 'HIGH' AND attack_type = 'dos'
ORDER BY ts_us DESC, alert_id DESC LIMIT 50 OFFSET 20
""", ("alerts_fx",))
def list_alerts(spark, d):
    return al.list_alerts(alerts_fx(spark, d), status="NEW", priority="HIGH", attack_type="dos", limit=50, offset=20).select(
        "alert_id", "ts_us", "source_ip", "attack_type")


@query("active_alerts", """
SELECT alert_id, ts_us, priority FROM alerts_fx WHERE status <> 'RESOLVED'
ORDER BY CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, ts_us DESC, alert_id DESC LIMIT 500
""", ("alerts_fx",))
def active_alerts(spark, d):
    return al.active_alerts(alerts_fx(spark, d), 500).select("alert_id", "ts_us", "priority")


@query("alerts_in_range", """
SELECT alert_id, ts_us FROM alerts_fx WHERE ts_us >= (SELECT max(ts_us) FROM alerts_fx) - 900000000
""", ("alerts_fx",))
def alerts_in_range(spark, d):
    return al.alerts_in_range(alerts_fx(spark, d), 900 * SECOND).select("alert_id", "ts_us")


@query("alert_stats", correlation_sql("alerts_fx") + f"""
SELECT count(*) AS total_alerts, count(*) FILTER (status <> 'RESOLVED') AS active_alerts, count(*) FILTER (status = 'RESOLVED') AS resolved_alerts,
  count(*) FILTER ((SELECT max(ts_us) FROM alerts_fx) - ts_us <= 3600000000) AS alerts_per_hour,
  {r6("avg((resolved_us - ts_us) / 1e6) FILTER (status = 'RESOLVED')")} AS average_resolution_time,
  (SELECT count(*) FROM grp) AS correlation_groups FROM alerts_fx
""", ("alerts_fx",))
def alert_stats(spark, d):
    a = alerts_fx(spark, d)
    return al.alert_stats(a, al.correlation_groups(a))


@query("alert_breakdown", """
SELECT 'priority' AS dimension, priority AS value, count(*) AS alerts FROM alerts_fx GROUP BY 2
UNION ALL SELECT 'attack_type', attack_type, count(*) FROM alerts_fx GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM alerts_fx GROUP BY 2
UNION ALL (SELECT 'source_ip', source_ip, count(*) AS c FROM alerts_fx GROUP BY 2 ORDER BY c DESC, source_ip LIMIT 10)
""", ("alerts_fx",))
def alert_breakdown(spark, d):
    return al.alert_breakdown(alerts_fx(spark, d))


@query("retention", """
, t AS (SELECT max(ts_us) AS now FROM alerts_fx)
SELECT alert_id, status FROM alerts_fx, t WHERE NOT (status = 'RESOLVED' AND ts_us < now - 600000000)
""", ("alerts_fx",))
def retention(spark, d):
    a = alerts_fx(spark, d)
    return al.retain(a, a.agg(F.max("ts_us")).scalar(), replace(DEFAULTS, retention_us=600 * SECOND)).select("alert_id", "status")


@query("attack_chart", f"""
, c AS (SELECT t.attack_type, count(a.alert_id) AS alerts FROM (VALUES ('port_scan'), ('dos'), ('brute_force'), ('anomaly_detection')) t(attack_type)
  LEFT JOIN alerts_fx a USING (attack_type) GROUP BY 1)
SELECT attack_type, alerts, {r6('alerts * 100.0::DOUBLE / greatest(max(alerts) OVER (), 1)')} AS percent FROM c
""", ("alerts_fx",))
def attack_chart(spark, d):
    return al.attack_chart(alerts_fx(spark, d))


@query("export_alerts", """
SELECT CAST(alert_id AS VARCHAR) AS id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, priority, status, source_ip, target_ip,
  attack_type, CAST(confidence AS VARCHAR) AS confidence, source, CAST(NULL AS VARCHAR) AS correlation_id, CAST(NULL AS VARCHAR) AS assigned_to,
  strftime(make_timestamp(resolved_us), '%Y-%m-%dT%H:%M:%S.%f') AS resolved_at, CAST(NULL AS VARCHAR) AS notes
FROM alerts_fx WHERE ts_us BETWEEN 1704067800000000 AND 1704069000000000
""", ("alerts_fx",))
def export_alerts(spark, d):
    path = scratch_path(spark, "alerts-csv")
    sinks.export_alerts(alerts_fx(spark, d), path, "csv", 1704067800000000, 1704069000000000)
    return spark.read.option("header", True).csv(path)


@query("export_alerts_json", """
, x AS (SELECT * FROM alerts_fx WHERE ts_us BETWEEN 1704067800000000 AND 1704069000000000)
SELECT 'alert' AS part, CAST(alert_id AS VARCHAR) AS id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, priority, target_ip, confidence, 1 AS alerts FROM x
UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, NULL, count(*) FROM x
UNION ALL SELECT 'priority', NULL, NULL, priority, NULL, NULL, count(*) FROM x GROUP BY priority
""", ("alerts_fx",))
def export_alerts_json(spark, d):
    """The JSON lines and their envelope, written and read back."""
    path = scratch_path(spark, "alerts-json")
    sinks.export_alerts(alerts_fx(spark, d), path, "json", 1704067800000000, 1704069000000000)
    lines = spark.read.schema("id string, timestamp string, priority string, target_ip string, confidence double").json(f"{path}/alerts")
    head = spark.read.schema("total_alerts bigint, alerts_by_priority map<string, bigint>").json(f"{path}/envelope")
    rows = lines.withColumns({"part": F.lit("alert"), "alerts": F.lit(1).cast("bigint")})
    total = head.select(F.lit("total").alias("part"), F.col("total_alerts").alias("alerts"))
    each = head.select(F.lit("priority").alias("part"), F.explode("alerts_by_priority").alias("priority", "alerts"))
    return rows.unionByName(total, allowMissingColumns=True).unionByName(each, allowMissingColumns=True)


@query("group_retention", correlation_sql("alerts_fx") + """
, t AS (SELECT max(ts_us) AS now FROM alerts_fx)
SELECT correlation_id, last_seen_us FROM grp, t WHERE last_seen_us >= now - 600000000
""", ("alerts_fx",))
def group_retention(spark, d):
    """Correlation groups seen within the retention time."""
    a = alerts_fx(spark, d)
    kept = al.retain_groups(al.correlation_groups(a), a.agg(F.max("ts_us")).scalar(), replace(DEFAULTS, retention_us=600 * SECOND))
    return kept.select("correlation_id", "last_seen_us")


@query("alert_file_sink", """
SELECT '{"timestamp":' || ts_us || ',"alert_id":' || alert_id || ',"priority":"' || priority || '","status":"' || status || '","source_ip":"' || source_ip
  || '",' || CASE WHEN target_ip IS NULL THEN '' ELSE '"target_ip":"' || target_ip || '",' END || '"attack_type":"' || attack_type
  || '","confidence":' || confidence || ',"source":"' || source || '"}' AS value FROM alerts_fx
""", ("alerts_fx",))
def alert_file_sink(spark, d):
    path = scratch_path(spark, "alert-lines")
    sinks.append_alert_lines(alerts_fx(spark, d), path)
    return spark.read.text(path)


# ---- notifications ------------------------------------------------------------------------------
@query("fan_out", """
SELECT alert_id, ts_us, channel, CASE priority WHEN 'LOW' THEN 'INFO' WHEN 'HIGH' THEN 'ERR' WHEN 'CRITICAL' THEN 'CRIT' ELSE 'WARNING' END AS level,
  '[IDS ALERT] ' || priority || ': ' || upper(attack_type) AS subject,
  CASE channel WHEN 'syslog' THEN 'IDS Alert [' || priority || '] ' || upper(attack_type) || ': Source: ' || source_ip || ', Target: '
      || coalesce(target_ip, 'N/A') || ', Confidence: ' || printf('%.2f', confidence * 100) || '%, ID: ' || alert_id
    WHEN 'file' THEN '{"alert_id":' || alert_id || ',"timestamp":' || ts_us || ',"priority":"' || priority || '","status":"' || status || '","source_ip":"'
      || source_ip || '",' || CASE WHEN target_ip IS NULL THEN '' ELSE '"target_ip":"' || target_ip || '",' END || '"attack_type":"' || attack_type
      || '","confidence":' || confidence || ',"source":"' || source || '"}'
    ELSE '[IDS ALERT] ' || priority || ': ' || upper(attack_type) END AS message
FROM alerts_fx, (VALUES ('syslog'), ('console'), ('file')) c(channel)
""", ("alerts_fx",))
def fan_out(spark, d):
    return no.fan_out(alerts_fx(spark, d))


@query("delivery_stats", f"""
, t AS (SELECT max(ts_us) AS now FROM deliveries_fx)
SELECT channel, count(*) AS total, count(*) FILTER (success) AS successful, {r6('count(*) FILTER (success) * 100.0::DOUBLE / count(*)')} AS success_rate,
  count(*) FILTER (NOT success AND now - ts_us <= 3600000000) AS recent_failures FROM deliveries_fx, t GROUP BY ROLLUP (channel)
""", ("deliveries_fx",))
def delivery_stats(spark, d):
    return no.delivery_stats(fx.view(spark, d, "deliveries_fx"))


@query("delivery_history", "SELECT * FROM deliveries_fx ORDER BY ts_us DESC, alert_id DESC, channel LIMIT 200", ("deliveries_fx",))
def delivery_history(spark, d):
    return no.delivery_history(fx.view(spark, d, "deliveries_fx"), 200)
