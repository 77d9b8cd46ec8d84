"""Logs and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlantern.operators import logs as lg, quality as qu
from flowlantern.plans.base import query
from flowlantern.plans.flows import FLOW_ROWS, stored_flows
from flowlantern.plans.rules import ALL_SQL, matches
from flowlantern.session import scratch_path
from flowlantern.sources import fixture as fx, sinks


def logs(spark, d):
    return fx.view(spark, d, "logs_fx")


@query("structured_events", """
SELECT log_id, ts_us, level, component, message, source_ip, '{"k":"' || json_extract(details, '$.k') || '","event_type":"' || split_part(message, ' ', 1)
  || '","session_id":"s' || log_id % 100 || '"}' AS details FROM logs_fx
""", ("logs_fx",))
def structured_events(spark, d):
    events = lg.structured_events(
        lg.with_details(logs(spark, d)), F.split_part("message", F.lit(" "), F.lit(1)),
        {"session_id": F.concat(F.lit("s"), (F.col("log_id") % 100).cast("string"))})
    return events.withColumn("details", F.to_json("details"))


@query("log_search", """
SELECT log_id, ts_us, message FROM logs_fx WHERE level = 'ERROR' AND component = 'ml_detection' AND ts_us >= 1704500000000000
  AND regexp_matches(message || ' ' || details, 'USER 1[0-9] .*"k": [5-9]', 'i') ORDER BY ts_us DESC, log_id DESC LIMIT 1000
""", ("logs_fx",))
def log_search(spark, d):
    return lg.log_search(logs(spark, d), 'USER 1[0-9] .*"k": [5-9]', level="error", component="ml_detection",
                         start_us=1704500000000000).select("log_id", "ts_us", "message")


@query("log_stats", """
, t AS (SELECT max(ts_us) AS now FROM logs_fx),
g AS (SELECT 'level' AS dimension, level AS value, count(*) AS entries FROM logs_fx GROUP BY 2
  UNION ALL SELECT 'component', component, count(*) FROM logs_fx GROUP BY 2
  UNION ALL (SELECT 'source_ip', source_ip, count(*) AS c FROM logs_fx WHERE source_ip IS NOT NULL GROUP BY 2 ORDER BY c DESC, source_ip LIMIT 10)
  UNION ALL SELECT 'total', 'all', count(*) FROM logs_fx)
SELECT g.*, CASE WHEN dimension = 'total' THEN (SELECT count(*) FROM logs_fx, t WHERE level IN ('ERROR', 'CRITICAL') AND now - ts_us <= 3600000000) END AS recent_errors,
  CASE WHEN dimension = 'total' THEN (SELECT floor((max(ts_us) - min(ts_us)) / 3600000000 * 1e6 + 0.5) / 1e6 FROM logs_fx) END AS span_hours
FROM g
""", ("logs_fx",))
def log_stats(spark, d):
    return lg.log_stats(logs(spark, d))


@query("recent_logs", """
SELECT log_id, ts_us, level, component FROM (SELECT * FROM logs_fx ORDER BY ts_us DESC, log_id DESC LIMIT 500) WHERE level = 'ERROR'
""", ("logs_fx",))
def recent_logs(spark, d):
    return lg.recent_logs(logs(spark, d), 500, level="error").select("log_id", "ts_us", "level", "component")


CUTOFF = 1705000000000000


@query("archive_logs", f"""
SELECT CASE WHEN ts_us < {CUTOFF} THEN 'archived' ELSE 'active' END AS place, level, count(*) AS entries, min(log_id) AS first_id FROM logs_fx GROUP BY 1, 2
""", ("logs_fx",))
def archive_logs(spark, d):
    path = scratch_path(spark, "log-archive")
    stay = lg.archive_logs(logs(spark, d), path, CUTOFF)
    both = stay.select(F.lit("active").alias("place"), "level", "log_id").unionByName(
        spark.read.parquet(path).select(F.lit("archived").alias("place"), "level", "log_id"))
    return both.groupBy("place", "level").agg(F.count("*").alias("entries"), F.min("log_id").alias("first_id"))


@query("export_logs", """
SELECT log_id, '[' || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || '] ' || level || ' ' || component || ': ' || message || chr(10)
  || CASE WHEN source_ip IS NULL THEN '' ELSE '  Source IP: ' || source_ip || chr(10) END
  || '  Details: {"k":"' || json_extract(details, '$.k') || '"}' || chr(10) AS block, CAST(json_extract(details, '$.k') AS VARCHAR) AS detail_k
FROM logs_fx WHERE level IN ('ERROR', 'CRITICAL')
""", ("logs_fx",))
def export_logs(spark, d):
    """The text blocks beside the flattened CSV column, the latter written and read back."""
    rows = lg.with_details(logs(spark, d)).where(F.col("level").isin("ERROR", "CRITICAL"))
    path = scratch_path(spark, "logs-csv")
    sinks.export_logs(rows.withColumn("message", F.col("log_id").cast("string")), path, "csv", ["k"])
    csv = spark.read.option("header", True).csv(path).select(F.col("message").cast("bigint").alias("log_id"), "detail_k")
    return sinks.log_text_lines(rows).select("log_id", "block").join(csv, "log_id")


@query("export_logs_text", """
SELECT '[' || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || '] ' || level || ' ' || component || ': ' || message AS line, count(*) AS entries
FROM logs_fx WHERE level IN ('ERROR', 'CRITICAL') GROUP BY 1
""", ("logs_fx",))
def export_logs_text(spark, d):
    """The text layout written and read back: the head line of every entry."""
    path = scratch_path(spark, "logs-txt")
    sinks.export_logs(lg.with_details(logs(spark, d)).where(F.col("level").isin("ERROR", "CRITICAL")), path, "txt")
    return spark.read.text(path).where(F.col("value").startswith("[")).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("entries"))


@query("export_logs_json", """
SELECT log_id, ts_us, level, component, message, source_ip, CAST(row_number() OVER (ORDER BY ts_us, log_id) AS BIGINT) AS place FROM logs_fx
""", ("logs_fx",))
def export_logs_json(spark, d):
    """JSON lines written and read back, with the place of each in the files by name and line: ascending time."""
    path = scratch_path(spark, "logs-json")
    sinks.export_logs(logs(spark, d), path, "json")
    rows = spark.read.schema("log_id bigint, ts_us bigint, level string, component string, message string, source_ip string").json(path)
    # the files of a sorted write are numbered in order; each is counted by itself and the lines of those before are added
    at = rows.withColumns({"file": F.input_file_name(), "line": F.monotonically_increasing_id()})
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = at.groupBy("file").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row per file
    inside = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return at.withColumn("inside", inside).join(first, "file").select(
        "log_id", "ts_us", "level", "component", "message", "source_ip", (F.col("base") + F.col("inside")).alias("place"))


# ---- quality ------------------------------------------------------------------------------------
DIRTY = """SELECT pid, CASE WHEN pid % 50 = 1 THEN 'unknown' WHEN pid % 50 = 2 THEN '256.1.1.1' WHEN pid % 50 = 3 THEN '2001:db8::1' ELSE src_ip END AS src_ip, dst_ip,
  CASE WHEN pid % 53 = 0 THEN 'XX' WHEN pid % 7 = 0 THEN lower(protocol) ELSE protocol END AS protocol,
  CASE WHEN pid % 61 = 0 THEN 70000 ELSE src_port END AS src_port, dst_port, CASE WHEN pid % 67 = 0 THEN -1 ELSE packet_size END AS packet_size, payload_size
  FROM packets"""


@query("validate_packets", f"""
, x AS ({DIRTY})
SELECT pid, concat_ws(',', CASE WHEN src_ip IN ('unknown', '256.1.1.1') THEN 'src_ip' END, CASE WHEN protocol = 'XX' THEN 'protocol' END,
  CASE WHEN src_port > 65535 THEN 'src_port' END, CASE WHEN packet_size < 0 THEN 'sizes' END) AS violations FROM x
""", ("packets",))
def validate_packets(spark, d):
    dirty = spark.sql(DIRTY.replace("FROM packets", "FROM {packets}"), packets=fx.packets(spark, d))
    return qu.validate_packets(dirty).select("pid", F.array_join("violations", ",").alias("violations"))


@query("validate_flows", FLOW_ROWS + """
SELECT 'duration' AS rule, count(*) AS rows FROM f WHERE flow_pid % 97 = 0 UNION ALL SELECT 'regularity', count(*) FROM f WHERE flow_pid % 89 = 0
UNION ALL SELECT 'protocol', count(*) FROM f WHERE flow_pid % 83 = 0
""", ("packets",), recursive=True)
def validate_flows(spark, d):
    i = F.col("flow_pid")
    f = stored_flows(spark, d).withColumns({
        "duration": F.when(i % 97 == 0, -1.0).otherwise(F.col("duration")),
        "regularity": F.when(i % 89 == 0, 1.5).otherwise(F.col("regularity")),
        "protocol": F.when(i % 83 == 0, F.lit("GRE")).otherwise(F.col("protocol"))})
    return qu.violation_counts(qu.validate_flows(f))


@query("validate_records", """
, x AS (SELECT alert_id, CASE WHEN alert_id % 31 = 0 THEN confidence + 1.01 ELSE confidence END AS confidence, CASE WHEN alert_id % 29 = 0 THEN 'other' ELSE status END AS status,
  CASE WHEN alert_id % 23 = 0 THEN -ts_us ELSE ts_us END AS ts_us FROM alerts_fx)
SELECT x.alert_id, concat_ws(',', CASE WHEN status = 'other' THEN 'status' END, CASE WHEN confidence > 1 THEN 'confidence' END,
  CASE WHEN x.ts_us < 0 THEN 'timestamp' END) AS violations, substr('b' || message || repeat('x', 250), 1, 255) AS text
FROM x JOIN logs_fx ON log_id = alert_id
""", ("alerts_fx", "logs_fx"))
def validate_records(spark, d):
    a = fx.view(spark, d, "alerts_fx")
    i = F.col("alert_id")
    now = a.agg(F.max("ts_us")).scalar()
    dirty = a.withColumns({
        "confidence": F.when(i % 31 == 0, F.col("confidence") + 1.01).otherwise(F.col("confidence")),
        "status": F.when(i % 29 == 0, "other").otherwise(F.col("status")),
        "ts_us": F.when(i % 23 == 0, -F.col("ts_us")).otherwise(F.col("ts_us")),
        "priority": F.lower("priority"), "attack_type": F.upper("attack_type")})
    text = F.concat(F.lit("<b>\"'\t\x7f"), "message", F.repeat(F.lit("x"), 250))
    messages = logs(spark, d).select(F.col("log_id").alias("alert_id"), qu.clean_text(text).alias("text"))
    return qu.validate_alerts(dirty, now).join(messages, "alert_id").select(
        "alert_id", F.array_join("violations", ",").alias("violations"), "text")


@query("validate_matches", ALL_SQL + """
, x AS (SELECT pid, signature_id, CASE WHEN pid % 5 = 0 THEN 'NONE' ELSE severity END AS severity, CASE WHEN pid % 7 = 0 THEN confidence + 1.01 ELSE confidence END AS confidence,
  CASE WHEN pid % 3 = 0 THEN 'nowhere' ELSE target_ip END AS target_ip FROM m)
SELECT pid, signature_id, concat_ws(',', CASE WHEN severity = 'NONE' THEN 'severity' END, CASE WHEN confidence > 1 THEN 'confidence' END,
  CASE WHEN target_ip = 'nowhere' THEN 'target_ip' END) AS violations FROM x
""", ("packets",))
def validate_matches(spark, d):
    """All matches with faults put into some, and the faults found."""
    i = F.col("pid")
    m = matches(spark, d).withColumns({
        "severity": F.when(i % 5 == 0, "NONE").otherwise(F.col("severity")),
        "confidence": F.when(i % 7 == 0, F.col("confidence") + 1.01).otherwise(F.col("confidence")),
        "target_ip": F.when(i % 3 == 0, "nowhere").otherwise(F.col("target_ip"))})
    now = fx.packets(spark, d).agg(F.max("ts_us")).scalar()
    return qu.validate_matches(m, now).select("pid", "signature_id", F.array_join("violations", ",").alias("violations"))
