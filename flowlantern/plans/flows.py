"""Connections, sessions, flows and traffic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlantern.config import SCALED
from flowlantern.functions.net import round6
from flowlantern.operators import connections as conn, flows as fl, windows as win
from flowlantern.plans.base import once, query
from flowlantern.plans.packets import DST_IN, SRC_IN
from flowlantern.session import scratch_path
from flowlantern.sources import fixture as fx

# Sessions of one protocol: lag and running sum over the plain rows, independent of the slices Spark uses.
SESSIONS = """
, k AS (SELECT *, least((src_ip, src_port), (dst_ip, dst_port)) AS lo, greatest((src_ip, src_port), (dst_ip, dst_port)) AS hi
  FROM packets WHERE protocol IN ('TCP', 'UDP') AND src_port <> 0 AND dst_port <> 0),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 300000000 THEN 0 ELSE 1 END AS o FROM k
  WINDOW w AS (PARTITION BY protocol, lo, hi ORDER BY ts_us, pid)),
x AS (SELECT *, sum(o) OVER (PARTITION BY protocol, lo, hi ORDER BY ts_us, pid) AS sn FROM g),
sess AS (SELECT protocol, arg_min(src_ip, ts_us) AS src_ip, arg_min(src_port, ts_us) AS src_port,
  arg_min(dst_ip, ts_us) AS dst_ip, arg_min(dst_port, ts_us) AS dst_port, min(ts_us) AS start_us, max(ts_us) AS last_us,
  round((max(ts_us) - min(ts_us)) / 1e6, 6) AS duration, count(*) AS packet_count,
  CAST(sum(packet_size) AS BIGINT) AS byte_count, arg_max(flags, ts_us) AS last_flags,
  string_agg(flags, '') AS all_flags FROM x GROUP BY protocol, lo, hi, sn),
s AS (SELECT *, CASE WHEN protocol = 'UDP' THEN 'ACTIVE'
  WHEN last_flags LIKE '%S%' AND last_flags NOT LIKE '%A%' THEN 'SYN_SENT' WHEN last_flags LIKE '%S%' THEN 'SYN_RECEIVED'
  WHEN last_flags LIKE '%F%' AND last_flags LIKE '%A%' THEN 'CLOSED' WHEN last_flags LIKE '%R%' THEN 'RESET'
  WHEN last_flags LIKE '%A%' THEN 'ESTABLISHED' ELSE 'UNKNOWN' END AS state FROM sess),
now AS (SELECT max(ts_us) AS t FROM packets)
"""


@query("tcp_connections", SESSIONS + """
SELECT protocol, src_ip, src_port, dst_ip, dst_port, start_us, last_us, duration, packet_count, byte_count, state,
  CASE WHEN all_flags = '' THEN '' ELSE list_aggregate(list_sort(list_distinct(string_split(all_flags, ''))), 'string_agg', '') END AS flags_seen
FROM s WHERE protocol = 'TCP'
""", ("packets",))
def tcp_connections(spark, d):
    return conn.tcp_connections(fx.packets(spark, d)).withColumn("flags_seen", F.array_join("flags_seen", ""))


@query("udp_sessions", SESSIONS + """
SELECT protocol, src_ip, src_port, dst_ip, dst_port, start_us, last_us, duration, packet_count, byte_count
FROM s WHERE protocol = 'UDP'
""", ("packets",))
def udp_sessions(spark, d):
    return conn.udp_sessions(fx.packets(spark, d))


@query("connection_stats", SESSIONS + """
, a AS (SELECT *, last_us >= t - 300000000 AS alive, t FROM s, now)
SELECT count(*) FILTER (alive AND protocol = 'TCP') AS tcp_connections,
  count(*) FILTER (alive AND state = 'ESTABLISHED') AS established,
  count(*) FILTER (alive AND state IN ('SYN_SENT', 'SYN_RECEIVED')) AS connecting,
  count(*) FILTER (alive AND state IN ('CLOSED', 'RESET')) AS closing,
  round(coalesce(avg((t - start_us) / 1e6) FILTER (alive AND protocol = 'TCP'), 0), 6) AS avg_duration,
  count(*) FILTER (alive AND protocol = 'UDP') AS udp_sessions,
  round(coalesce(avg(packet_count) FILTER (alive AND protocol = 'UDP'), 0), 6) AS avg_packets_per_session,
  count(*) FILTER (NOT alive AND protocol = 'TCP') AS history_size
FROM a
""", ("packets",))
def connection_stats(spark, d):
    return conn.connection_stats(fx.packets(spark, d))


@query("active_connections", SESSIONS + """
SELECT protocol, src_ip, src_port, dst_ip, dst_port, start_us, last_us, duration, packet_count, byte_count, state
FROM s, now WHERE last_us >= t - 300000000
ORDER BY protocol, last_us DESC, src_ip, src_port, dst_ip, dst_port LIMIT 100
""", ("packets",))
def active_connections(spark, d):
    return conn.active_connections(fx.packets(spark, d))


# Flow segmentation by recursion over the packets of a key.
FLOW_CTE = """
, o AS (SELECT *, src_ip || ':' || coalesce(src_port, 0) || '-' || dst_ip || ':' || coalesce(dst_port, 0) || '-' || protocol AS flow_key
  FROM packets),
r AS MATERIALIZED (SELECT pid, ts_us, flow_key, row_number() OVER (PARTITION BY flow_key ORDER BY ts_us, pid) AS rn FROM o),
w AS (
  SELECT flow_key, rn, pid, ts_us, ts_us AS fs, pid AS fp, 1 AS n, FALSE AS closed, CAST(0 AS BIGINT) AS iat FROM r WHERE rn = 1
  UNION ALL
  SELECT flow_key, rn, pid, ts_us, fs, fp, n, ts_us - fs > 60000000 OR n > 1000, iat FROM (
    SELECT r.flow_key, r.rn, r.pid, r.ts_us,
      CASE WHEN w.closed OR r.ts_us - w.ts_us > 60000000 THEN r.ts_us ELSE w.fs END AS fs,
      CASE WHEN w.closed OR r.ts_us - w.ts_us > 60000000 THEN r.pid ELSE w.fp END AS fp,
      CASE WHEN w.closed OR r.ts_us - w.ts_us > 60000000 THEN 1 ELSE w.n + 1 END AS n,
      CASE WHEN w.closed OR r.ts_us - w.ts_us > 60000000 THEN 0 ELSE r.ts_us - w.ts_us END AS iat
    FROM w JOIN r ON r.flow_key = w.flow_key AND r.rn = w.rn + 1)
)
"""
FLOW_ROWS = FLOW_CTE + """
, m AS (SELECT o.*, w.fp, w.iat FROM o JOIN w ON o.pid = w.pid),
f0 AS (SELECT fp AS flow_pid, any_value(flow_key) AS flow_key, any_value(src_ip) AS src_ip, any_value(dst_ip) AS dst_ip,
    coalesce(any_value(src_port), 0) AS src_port, coalesce(any_value(dst_port), 0) AS dst_port, any_value(protocol) AS protocol,
    min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS byte_count,
    (max(ts_us) - min(ts_us)) / 1e6 AS duration,
    coalesce(stddev_samp(iat / 1e6), 0) AS iat_sd, coalesce(stddev_samp(packet_size), 0) AS size_sd,
    min(packet_size) AS min_packet_size, max(packet_size) AS max_packet_size,
    CASE WHEN any_value((src_ip, coalesce(src_port, 0)) <= (dst_ip, coalesce(dst_port, 0))) THEN 1 ELSE 0 END AS fw,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'S') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_S,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'A') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_A,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'F') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_F,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'R') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_R,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'P') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_P,
    CAST(sum(CASE WHEN protocol = 'TCP' AND contains(flags, 'U') THEN 1 ELSE 0 END) AS BIGINT) AS tcp_flag_U,
    max(label) AS label
  FROM m GROUP BY fp),
f1 AS (SELECT *, CASE WHEN duration > 0 THEN packet_count / duration ELSE 0 END AS packets_per_second,
    CASE WHEN duration > 0 THEN byte_count / duration ELSE 0 END AS bytes_per_second,
    duration / packet_count AS avg_inter_arrival_time, iat_sd AS std_inter_arrival_time,
    byte_count / packet_count AS avg_packet_size, size_sd AS std_packet_size,
    packet_count * fw AS src_to_dst_packets, packet_count * (1 - fw) AS dst_to_src_packets,
    byte_count * fw AS src_to_dst_bytes, byte_count * (1 - fw) AS dst_to_src_bytes,
    """ + SRC_IN + " AS is_internal_src, " + DST_IN + """ AS is_internal_dst,
    src_port BETWEEN 1 AND 1023 OR dst_port BETWEEN 1 AND 1023 AS is_well_known_port,
    CAST(0 AS DOUBLE) AS port_scan_indicator, tcp_flag_S / packet_count AS syn_flood_ratio,
    CASE WHEN duration > 0 THEN iat_sd / (duration / packet_count) ELSE 0 END AS burstiness FROM f0),
f AS (SELECT *, 1 / (1 + burstiness) AS regularity FROM f1)
"""
DOUBLES = [
    "duration", "packets_per_second", "bytes_per_second", "avg_inter_arrival_time", "std_inter_arrival_time",
    "avg_packet_size", "std_packet_size", "port_scan_indicator", "syn_flood_ratio", "burstiness", "regularity",
]


def _r(*cols):
    return ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {c}" for c in cols)


def rounded(df, cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


def features(spark, d):
    return fl.flow_features(fl.flow_packets(fx.packets(spark, d)))


def stored_flows(spark, d):
    """The flow table, written once per session; feature and model queries read it as any stored table."""
    def make():
        path = scratch_path(spark, "flows")
        features(spark, d).write.parquet(path)
        return path
    return spark.read.parquet(once(spark, d, "flows", make))


@query("flows", FLOW_ROWS + """
SELECT flow_pid, flow_key, start_us, end_us, packet_count, byte_count FROM f
""", ("packets",), recursive=True)
def flows(spark, d):
    return fl.flows(fl.flow_packets(fx.packets(spark, d)))


@query("flow_features", FLOW_ROWS + f"""
SELECT flow_pid, flow_key, src_ip, dst_ip, src_port, dst_port, protocol, start_us, end_us, packet_count, byte_count,
  {_r(*DOUBLES)},
  min_packet_size, max_packet_size, src_to_dst_packets, dst_to_src_packets, src_to_dst_bytes, dst_to_src_bytes,
  is_internal_src, is_internal_dst, is_well_known_port,
  concat_ws(',', CASE WHEN tcp_flag_A > 0 THEN 'A=' || tcp_flag_A END, CASE WHEN tcp_flag_F > 0 THEN 'F=' || tcp_flag_F END,
    CASE WHEN tcp_flag_P > 0 THEN 'P=' || tcp_flag_P END, CASE WHEN tcp_flag_R > 0 THEN 'R=' || tcp_flag_R END,
    CASE WHEN tcp_flag_S > 0 THEN 'S=' || tcp_flag_S END, CASE WHEN tcp_flag_U > 0 THEN 'U=' || tcp_flag_U END) AS tcp_flags_count
FROM f
""", ("packets",), recursive=True)
def flow_features(spark, d):
    out = fl.flag_map(rounded(features(spark, d), DOUBLES))
    pairs = F.transform(F.array_sort(F.map_entries("tcp_flags_count")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("tcp_flags_count", F.array_join(pairs, ",")).drop(
        "label", *[f"tcp_flag_{x}" for x in fl.FLAGS])


@query("flow_direction", """
, p AS (SELECT *, (src_ip, coalesce(src_port, 0)) <= (dst_ip, coalesce(dst_port, 0)) AS fw FROM packets)
SELECT least(src_ip, dst_ip) AS low_ip, greatest(src_ip, dst_ip) AS high_ip, count(*) FILTER (fw) AS forward_packets,
  count(*) FILTER (NOT fw) AS reverse_packets, CAST(coalesce(sum(packet_size) FILTER (fw), 0) AS BIGINT) AS forward_bytes,
  CAST(coalesce(sum(packet_size) FILTER (NOT fw), 0) AS BIGINT) AS reverse_bytes
FROM p GROUP BY 1, 2
""", ("packets",))
def flow_direction(spark, d):
    return fl.flow_direction(fx.packets(spark, d))


VECTOR_SQL = ", ".join(
    [_r(*fl.VECTOR)]
    + [f"CAST(tcp_flag_{x} AS DOUBLE) AS tcp_flag_{x}" for x in fl.FLAGS]
    + [f"CAST(protocol = '{p}' AS DOUBLE) AS protocol_{p}" for p in fl.PROTOCOLS]
)


@query("flow_vector", FLOW_ROWS + f"SELECT flow_pid, {VECTOR_SQL} FROM f", ("packets",), recursive=True)
def flow_vector(spark, d):
    return rounded(fl.flow_vector(features(spark, d)), fl.VECTOR)


# ---- windows ------------------------------------------------------------------------------------
def window_cte(dos=(1000, 10000), exfil=(10 * 1024 * 1024, 100 * 1024 * 1024)) -> str:
    return f"""
, p AS (SELECT *, ts_us - ts_us % 10000000 AS window_us, {SRC_IN} AS si, {DST_IN} AS di FROM packets),
t AS (SELECT window_us, count(*) AS total_packets, CAST(sum(packet_size) AS BIGINT) AS total_bytes,
    count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
    count(DISTINCT (src_ip, coalesce(src_port, 0), dst_ip, coalesce(dst_port, 0), protocol)) AS flow_keys,
    CAST(coalesce(sum(packet_size) FILTER (si AND NOT di), 0) AS BIGINT) AS outbound_bytes,
    count(*) FILTER (protocol = 'TCP') / count(*) AS tcp_ratio, count(*) FILTER (protocol = 'UDP') / count(*) AS udp_ratio,
    count(*) FILTER (protocol = 'ICMP') / count(*) AS icmp_ratio, count(*) FILTER (protocol = 'ARP') / count(*) AS arp_ratio,
    count(*) FILTER (protocol = 'TCP' AND flags IN ('', 'F', 'FPU')) AS odd
  FROM p GROUP BY 1),
pt AS (SELECT window_us, count(DISTINCT port) AS unique_ports FROM (
    SELECT window_us, src_port AS port FROM p UNION ALL SELECT window_us, dst_port FROM p) WHERE port <> 0 GROUP BY 1),
sp AS (SELECT window_us, max(k) AS max_src_ports FROM (
    SELECT window_us, src_ip, count(DISTINCT coalesce(dst_port, 0)) FILTER (si <> di) AS k FROM p GROUP BY 1, 2) GROUP BY 1),
dp AS (SELECT window_us, max(k) / 10 AS max_rate FROM (SELECT window_us, dst_ip, count(*) AS k FROM p GROUP BY 1, 2) GROUP BY 1),
wf AS (SELECT t.*, coalesce(unique_ports, 0) AS unique_ports, max_src_ports, max_rate, flow_keys / 10 AS new_flows_per_second,
    flow_keys / total_packets AS flow_diversity,
    CASE WHEN max_src_ports > 10 THEN least(max_src_ports / 50, 1) ELSE 0 END AS port_scan_score,
    CASE WHEN max_rate > {dos[0]} THEN least(max_rate / {dos[1]}, 1) ELSE 0 END AS dos_score,
    CASE WHEN outbound_bytes > {exfil[0]} THEN least(outbound_bytes / {exfil[1]}, 1) ELSE 0 END AS data_exfiltration_score,
    (CAST(icmp_ratio > 0.1 AS INT) + CAST(odd > 0 AS INT)) / 2 AS unusual_protocol_score
  FROM t LEFT JOIN pt USING (window_us) JOIN sp USING (window_us) JOIN dp USING (window_us))
"""


FLOW_WINDOWS = """
, fd AS (SELECT end_us - end_us % 10000000 AS window_us, avg(duration) AS afd FROM f GROUP BY 1),
wx AS (SELECT wf.*, coalesce(afd, 0) AS avg_flow_duration FROM wf LEFT JOIN fd USING (window_us))
"""


@query("window_aggregates", window_cte() + """
SELECT window_us, total_packets, total_bytes, unique_sources, unique_destinations, unique_ports FROM wf
""", ("packets",))
def window_aggregates(spark, d):
    return win.window_aggregates(fx.packets(spark, d))


@query("window_protocol_ratios", """
, c AS (SELECT ts_us - ts_us % 10000000 AS window_us, protocol, count(*) AS n FROM packets GROUP BY 1, 2)
SELECT window_us, protocol, round(n / sum(n) OVER (PARTITION BY window_us), 6) AS share FROM c
""", ("packets",))
def window_protocol_ratios(spark, d):
    return win.window_protocol_ratios(fx.packets(spark, d)).select(
        "window_us", F.explode("protocol_ratios").alias("protocol", "s")).select(
        "window_us", "protocol", round6(F.col("s")).alias("share"))


@query("window_flow_patterns", FLOW_ROWS + window_cte() + FLOW_WINDOWS + f"""
SELECT window_us, {_r('new_flows_per_second', 'flow_diversity', 'avg_flow_duration')} FROM wx
""", ("packets",), recursive=True)
def window_flow_patterns(spark, d):
    p = fx.packets(spark, d)
    return rounded(win.window_flow_patterns(p, fl.flows(fl.flow_packets(p))),
                   ["new_flows_per_second", "flow_diversity", "avg_flow_duration"])


@query("port_scan_score", window_cte() + f"SELECT window_us, max_src_ports, {_r('port_scan_score')} FROM wf", ("packets",))
def port_scan_score(spark, d):
    return rounded(win.port_scan_scores(fx.packets(spark, d)), ["port_scan_score"])


@query("dos_score", window_cte() + f"SELECT window_us, {_r('max_rate', 'dos_score')} FROM wf", ("packets",))
def dos_score(spark, d):
    return rounded(win.dos_scores(fx.packets(spark, d)), ["max_rate", "dos_score"])


@query("dos_score_scaled", window_cte(dos=(5, 50)) + f"SELECT window_us, {_r('max_rate', 'dos_score')} FROM wf", ("packets",))
def dos_score_scaled(spark, d):
    return rounded(win.dos_scores(fx.packets(spark, d), SCALED), ["max_rate", "dos_score"])


@query("data_exfiltration_score", window_cte() + f"""
SELECT window_us, outbound_bytes, {_r('data_exfiltration_score')} FROM wf""", ("packets",))
def data_exfiltration_score(spark, d):
    return rounded(win.exfiltration_scores(fx.packets(spark, d)), ["data_exfiltration_score"])


@query("data_exfiltration_score_scaled", window_cte(exfil=(20000, 200000)) + f"""
SELECT window_us, outbound_bytes, {_r('data_exfiltration_score')} FROM wf""", ("packets",))
def data_exfiltration_score_scaled(spark, d):
    return rounded(win.exfiltration_scores(fx.packets(spark, d), SCALED), ["data_exfiltration_score"])


@query("unusual_protocol_score", window_cte() + f"SELECT window_us, {_r('unusual_protocol_score')} FROM wf", ("packets",))
def unusual_protocol_score(spark, d):
    return rounded(win.unusual_protocol_scores(fx.packets(spark, d)), ["unusual_protocol_score"])


def window_rows(spark, d, th=SCALED):
    p = fx.packets(spark, d)
    return win.window_features(p, fl.flows(fl.flow_packets(p)), th)


@query("window_vector", FLOW_ROWS + window_cte((5, 50), (20000, 200000)) + FLOW_WINDOWS + f"""
SELECT window_us, {_r(*win.WINDOW_VECTOR)} FROM wx
""", ("packets",), recursive=True)
def window_vector(spark, d):
    return rounded(win.window_vector(window_rows(spark, d)), win.WINDOW_VECTOR)
