"""Streaming jobs, run to the end over the whole table written as a few files in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlantern.config import SCALED, SECOND
from flowlantern.functions.net import round6
from flowlantern.operators import ensemble as en, features as ft, flows as fl, models as mo, notify as no, packets as pk, rules as ru, windows as win
from flowlantern.plans.base import query
from flowlantern.plans.flows import DOUBLES, DST_IN, SRC_IN, rounded
from flowlantern.session import scratch_path
from flowlantern.sources import fixture as fx, readers, sinks
from flowlantern.streaming import alerts as sa, flows as sf, rules as sr, windows as sw

PARTS = 3
FAR_US = 30 * 86_400 * SECOND  # a last row this far ahead moves the watermark past every open group


def feed(spark: SparkSession, df: DataFrame, mark: bool = True) -> str:
    """Writes ``df`` as consecutive time ranges of equally many files, then one far-future row that closes all windows.

    A trigger that takes that many files sees one range at a time, so no row is late.
    """
    path = scratch_path(spark, "feed")
    lo, hi = df.agg(F.min("ts_us"), F.max("ts_us")).first()
    step = (hi - lo) // PARTS + 1
    for i in range(PARTS):
        df.where((F.col("ts_us") >= lo + i * step) & (F.col("ts_us") < lo + (i + 1) * step)).repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(path)
    if mark:
        df.where(F.col("ts_us") == hi).limit(1).withColumn("ts_us", F.col("ts_us") + FAR_US).coalesce(1).write.mode("append").parquet(path)
    return path


def open_feed(spark: SparkSession, df: DataFrame, mark: bool = True) -> DataFrame:
    return readers.stream_packets(spark, feed(spark, df, mark), files_per_trigger=spark.sparkContext.defaultParallelism, schema=df.schema)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream until its input is used up and reads what it wrote."""
    out = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_packets", """
SELECT protocol, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes FROM packets GROUP BY 1
""", ("packets",))
def stream_packets(spark, d):
    """Packets through a handler that writes each micro-batch to its own part of a table."""
    out = scratch_path(spark, "captured")
    stream = open_feed(spark, fx.packets(spark, d), mark=False)
    keep = lambda batch, number: sinks.write_batch(pk.scan_packets(batch), out, number)
    readers.with_handlers(stream, [keep], scratch_path(spark, "captured-ckpt")).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_batches(spark, out).groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))


def _window_oracle():
    from flowlantern.plans.flows import FLOW_ROWS, FLOW_WINDOWS, _r, window_cte

    return FLOW_ROWS + window_cte((5, 50), (20000, 200000)) + FLOW_WINDOWS + f"SELECT window_us, {_r(*win.WINDOW_VECTOR)} FROM wx"


@query("streaming_windows", _window_oracle(), ("packets",), recursive=True)
def streaming_windows(spark, d):
    """All columns of the batch window vector, from packets and from the flows that another stream has closed."""
    closed = _streamed_flows(spark, d).select(
        F.col("end_us").alias("ts_us"), "start_us", "end_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    rows = sw.streaming_windows(open_feed(spark, fx.packets(spark, d)), open_feed(spark, closed), th=SCALED)
    return rounded(win.window_vector(drain(spark, rows, "windows")), win.WINDOW_VECTOR)


@query("streaming_scan_scores", f"""
, p AS (SELECT ts_us - ts_us % 10000000 AS window_us, src_ip, coalesce(dst_port, 0) AS port FROM packets WHERE {SRC_IN} <> {DST_IN})
, k AS (SELECT window_us, src_ip, count(DISTINCT port) AS ports FROM p GROUP BY 1, 2)
SELECT window_us, max(ports) AS max_src_ports FROM k GROUP BY 1
""", ("packets",))
def streaming_scan_scores(spark, d):
    return drain(spark, sw.streaming_scan_scores(open_feed(spark, fx.packets(spark, d))), "scans").select("window_us", "max_src_ports")


@query("streaming_dos_scores", """
SELECT window_us, floor(max(k) / 10 * 1e6 + 0.5) / 1e6 AS max_rate FROM (SELECT ts_us - ts_us % 10000000 AS window_us, dst_ip, count(*) AS k FROM packets GROUP BY 1, 2) GROUP BY 1
""", ("packets",))
def streaming_dos_scores(spark, d):
    stream = open_feed(spark, fx.packets(spark, d))
    return drain(spark, sw.streaming_dos_scores(stream), "dos").select("window_us", (F.floor(F.col("max_rate") * 1e6 + 0.5) / 1e6).alias("max_rate"))


def _streamed_flows(spark, d):
    return drain(spark, sf.full_flows(open_feed(spark, fx.packets(spark, d))), "flows")


@query("streaming_idle_flows", """
, k AS (SELECT *, src_ip || ':' || coalesce(src_port, 0) || '-' || dst_ip || ':' || coalesce(dst_port, 0) || '-' || protocol AS flow_key FROM packets),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us) <= 60000000 THEN 0 ELSE 1 END AS o FROM k),
x AS (SELECT *, sum(o) OVER (PARTITION BY flow_key ORDER BY ts_us) AS sn FROM g)
SELECT flow_key, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS byte_count FROM x GROUP BY flow_key, sn
""", ("packets",))
def streaming_idle_flows(spark, d):
    return drain(spark, sf.idle_flows(open_feed(spark, fx.packets(spark, d))), "idle-flows")


_FLOW_COLUMNS = ["flow_pid", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "end_us", "packet_count",
                 "byte_count", "min_packet_size", "max_packet_size", "src_to_dst_packets", "dst_to_src_packets", "src_to_dst_bytes",
                 "dst_to_src_bytes", "is_internal_src", "is_internal_dst", "is_well_known_port", *[f"tcp_flag_{x}" for x in fl.FLAGS], "label"]


def _flow_oracle():
    from flowlantern.plans.flows import FLOW_ROWS

    doubles = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e4 + 0.5) / 1e4 AS {c}" for c in DOUBLES)
    return FLOW_ROWS + f"SELECT {', '.join(_FLOW_COLUMNS)}, {doubles} FROM f"


@query("streaming_flows", _flow_oracle(), ("packets",), recursive=True)
def streaming_flows(spark, d):
    """The closed flows with all features; sums of squares give their deviations, so four decimals are compared."""
    return _streamed_flows(spark, d).select(
        *_FLOW_COLUMNS, *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in DOUBLES])


def _match_oracle():
    from flowlantern.plans.rules import _REGEX, _SIMPLE, _sql, behavioural_sql

    head = "pid, ts_us, source_ip, target_ip, signature_id, severity, category, floor(CAST(confidence AS DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence"
    parts = [f"SELECT {head}, CAST(NULL AS BIGINT) AS frame_count, CAST(NULL AS BIGINT) AS frame_distinct FROM ({_sql(_SIMPLE + _REGEX)})"] + [
        f"SELECT {head}, frame_count, frame_distinct FROM ({behavioural_sql(i)})" for i in _RULES]
    return "\nUNION ALL ".join(parts)


_RULES = ("port_scan_basic", "port_scan_aggressive", "syn_flood", "udp_flood", "icmp_flood", "dns_amplification", "ssh_brute_force",
          "rdp_brute_force")


@query("streaming_matches", _match_oracle(), ("packets",))
def streaming_matches(spark, d):
    p = fx.packets(spark, d)
    quick = drain(spark, sr.stateless(open_feed(spark, p, mark=False), ru.DEFAULT_RULES), "quick")
    slow = drain(spark, sr.behavioural(open_feed(spark, p, mark=False), [ru.default_rule(i) for i in _RULES], buckets=spark.sparkContext.defaultParallelism), "slow")
    none = F.lit(None).cast("bigint")
    found = slow.unionByName(quick.withColumns({"frame_count": none, "frame_distinct": none}), allowMissingColumns=True)
    return found.select("pid", "ts_us", "source_ip", "target_ip", "signature_id", "severity", "category",
                        round6(F.col("confidence")).alias("confidence"), "frame_count", "frame_distinct")


def _admission_oracle():
    from flowlantern.plans.alerts import LIMITER, _dedup

    return LIMITER + ", kept1 AS (SELECT alerts_fx.* FROM alerts_fx JOIN lim USING (alert_id) WHERE ok)" + _dedup(
        "kept1") + "SELECT alert_id FROM dd WHERE keep"


@query("streaming_alerts", _admission_oracle(), ("alerts_fx",), recursive=True)
def streaming_alerts(spark, d):
    out = drain(spark, sa.admit(open_feed(spark, fx.view(spark, d, "alerts_fx"), mark=False)), "alerts")
    return out.where(~F.col("rate_limited") & ~F.col("duplicate")).select("alert_id")


@query("streaming_scoring")
def streaming_scoring(spark, d):
    """Flows scored as they close: the ensemble trained on the stored flows votes on the streamed ones."""
    from flowlantern.plans.models import trained

    models, out = trained(spark, d)[0], scratch_path(spark, "scored")

    def score(batch: DataFrame, number: int) -> None:
        rows = ft.ml_flow_features(batch, (F.col("end_us").alias("ts_us"), F.col("src_ip"), F.col("dst_ip")))
        det = en.wide_detections(mo.voted(models, rows)).select("pid", "ts_us", "is_anomaly", "confidence")
        sinks.write_batch(det, out, number)

    closed = sf.full_flows(open_feed(spark, fx.packets(spark, d)))
    readers.with_handlers(closed, [score], scratch_path(spark, "scored-ckpt")).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_batches(spark, out)


@query("delivery_sink", """
SELECT channel, count(*) AS messages, count(*) FILTER (alert_id % 10 <> 7) AS delivered, CAST(sum(CASE WHEN alert_id % 10 = 7 THEN 2 WHEN alert_id % 10 = 3 THEN 0 ELSE 0 END) AS BIGINT) AS retries
FROM alerts_fx, (VALUES ('syslog'), ('console'), ('file')) c(channel) GROUP BY 1
""", ("alerts_fx",))
def delivery_sink(spark, d):
    """Every rendered message through a sender that refuses some alerts for good."""
    def send(alert_id: str, channel: str, message: str) -> None:
        if alert_id.endswith("7"):
            raise RuntimeError("refused")

    results = sa.deliver(no.fan_out(fx.view(spark, d, "alerts_fx")), send)
    return results.groupBy("channel").agg(F.count("*").alias("messages"), F.count_if("success").alias("delivered"),
                                          F.sum("retry_count").alias("retries"))


@query("warehouse_tables", """
SELECT 'alerts' AS name, count(*) AS rows, min(ts_us) AS first_us FROM alerts_fx UNION ALL SELECT 'system_logs', count(*), min(ts_us) FROM logs_fx WHERE ts_us >= 1704585600000000
""", ("alerts_fx", "logs_fx"))
def warehouse_tables(spark, d):
    """Alerts and logs stored by date and read back, the logs with a pruning date bound."""
    root = scratch_path(spark, "warehouse")
    readers.append_table(fx.view(spark, d, "alerts_fx").withColumn("id", F.col("alert_id").cast("string")), root, "alerts")
    readers.append_table(fx.view(spark, d, "logs_fx"), root, "system_logs")
    a = readers.read_table(spark, root, "alerts").select(F.lit("alerts").alias("name"), "ts_us")
    l = readers.read_table(spark, root, "system_logs", from_date="2024-01-07").select(F.lit("system_logs").alias("name"), "ts_us")
    return a.unionByName(l).groupBy("name").agg(F.count("*").alias("rows"), F.min("ts_us").alias("first_us"))
