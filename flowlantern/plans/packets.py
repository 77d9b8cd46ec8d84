"""Packet scans, projections and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlantern.functions import net
from flowlantern.operators import connections, packets as op
from flowlantern.plans.base import query
from flowlantern.sources import fixture as fx

_IN = "({c} LIKE '10.%' OR {c} LIKE '192.168.%' OR {c} LIKE '127.%' OR regexp_matches({c}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
SRC_IN, DST_IN = _IN.format(c="src_ip"), _IN.format(c="dst_ip")
DIRECTION = (
    f"CASE WHEN {SRC_IN} AND NOT {DST_IN} THEN 'outbound' WHEN NOT {SRC_IN} AND {DST_IN} THEN 'inbound' "
    f"WHEN {SRC_IN} AND {DST_IN} THEN 'internal' ELSE 'external' END"
)
SERVICE = """CASE protocol WHEN 'TCP' THEN coalesce(CASE dst_port WHEN 20 THEN 'FTP-DATA' WHEN 21 THEN 'FTP' WHEN 22 THEN 'SSH'
  WHEN 23 THEN 'TELNET' WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 110 THEN 'POP3' WHEN 143 THEN 'IMAP'
  WHEN 443 THEN 'HTTPS' WHEN 993 THEN 'IMAPS' WHEN 995 THEN 'POP3S' WHEN 3389 THEN 'RDP' WHEN 5432 THEN 'POSTGRESQL'
  WHEN 3306 THEN 'MYSQL' WHEN 6379 THEN 'REDIS' WHEN 27017 THEN 'MONGODB' END, 'UNKNOWN-' || dst_port)
  ELSE coalesce(CASE dst_port WHEN 53 THEN 'DNS' WHEN 67 THEN 'DHCP-SERVER' WHEN 68 THEN 'DHCP-CLIENT' WHEN 123 THEN 'NTP'
  WHEN 161 THEN 'SNMP' WHEN 500 THEN 'IPSEC-IKE' WHEN 514 THEN 'SYSLOG' WHEN 4500 THEN 'IPSEC-NAT-T' END, 'UNKNOWN-' || dst_port) END"""


@query("scan_packets", """
SELECT pid, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, packet_size, payload_size, flags, ttl FROM packets
""", ("packets",))
def scan_packets(spark, d):
    return op.scan_packets(fx.packets(spark, d))


@query("capture_filter", """
SELECT pid, ts_us, src_ip, dst_ip, packet_size FROM packets
WHERE protocol = 'TCP' AND (src_port = 80 OR dst_port = 80)
""", ("packets",))
def capture_filter(spark, d):
    df = op.capture_filter(fx.packets(spark, d), "protocol = 'TCP' AND (src_port = 80 OR dst_port = 80)")
    return df.select("pid", "ts_us", "src_ip", "dst_ip", "packet_size")


@query("packet_features", f"""
SELECT pid, ts_us, packet_size, payload_size, coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port,
  protocol, ttl, CAST(length(flags) AS INT) AS flag_count,
  protocol = 'TCP' AND contains(flags, 'S') AS is_syn, protocol = 'TCP' AND contains(flags, 'A') AS is_ack,
  protocol = 'TCP' AND contains(flags, 'F') AS is_fin, protocol = 'TCP' AND contains(flags, 'R') AS is_rst,
  protocol = 'TCP' AND contains(flags, 'P') AS is_psh,
  {SRC_IN} AS is_internal_src, {DST_IN} AS is_internal_dst, {SRC_IN} <> {DST_IN} AS is_cross_boundary,
  coalesce(src_port BETWEEN 1 AND 1023, FALSE) OR coalesce(dst_port BETWEEN 1 AND 1023, FALSE) AS is_well_known_port
FROM packets
""", ("packets",))
def packet_features(spark, d):
    return op.packet_features(fx.packets(spark, d))


@query("cross_boundary_bytes", f"""
SELECT ts_us - ts_us % 10000000 AS window_us, {DIRECTION} AS direction, count(*) AS packets,
  CAST(sum(packet_size) AS BIGINT) AS bytes
FROM packets GROUP BY 1, 2
""", ("packets",))
def cross_boundary_bytes(spark, d):
    return op.cross_boundary_bytes(fx.packets(spark, d))


@query("service_traffic", f"""
SELECT protocol, {SERVICE} AS service, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes
FROM packets WHERE protocol IN ('TCP', 'UDP') GROUP BY 1, 2
""", ("packets",))
def service_traffic(spark, d):
    return op.service_traffic(fx.packets(spark, d))


@query("tcp_state_counts", """
SELECT dst_ip, CASE WHEN flags LIKE '%S%' AND flags NOT LIKE '%A%' THEN 'SYN_SENT' WHEN flags LIKE '%S%' THEN 'SYN_RECEIVED'
  WHEN flags LIKE '%F%' AND flags LIKE '%A%' THEN 'CLOSED' WHEN flags LIKE '%R%' THEN 'RESET'
  WHEN flags LIKE '%A%' THEN 'ESTABLISHED' ELSE 'UNKNOWN' END AS state, count(*) AS packets
FROM packets WHERE protocol = 'TCP' GROUP BY 1, 2
""", ("packets",))
def tcp_state_counts(spark, d):
    return op.tcp_state_counts(fx.packets(spark, d))


@query("scan_types_by_source", """
SELECT src_ip, scan_type, count(*) AS packets, count(DISTINCT dst_ip) AS targets FROM (
  SELECT src_ip, dst_ip, CASE WHEN flags = 'F' THEN 'FIN' WHEN flags = '' THEN 'NULL'
    WHEN list_has_all(string_split(flags, ''), ['F', 'P', 'U']) AND flags NOT LIKE '%A%' THEN 'XMAS' END AS scan_type
  FROM packets WHERE protocol = 'TCP') WHERE scan_type IS NOT NULL GROUP BY 1, 2
""", ("packets",))
def scan_types_by_source(spark, d):
    return op.scan_types_by_source(fx.packets(spark, d))


@query("icmp_summary", """
SELECT CASE WHEN icmp_type = 0 THEN 'Echo Reply' WHEN icmp_type = 5 THEN 'Redirect' WHEN icmp_type = 8 THEN 'Echo Request'
  WHEN icmp_type = 11 THEN 'Time Exceeded' WHEN icmp_type = 3 THEN 'Destination Unreachable - ' || CASE icmp_code
    WHEN 0 THEN 'Network Unreachable' WHEN 1 THEN 'Host Unreachable' WHEN 2 THEN 'Protocol Unreachable'
    WHEN 3 THEN 'Port Unreachable' WHEN 4 THEN 'Fragmentation Needed' WHEN 5 THEN 'Source Route Failed'
    ELSE 'Code ' || icmp_code END
  ELSE 'Type ' || icmp_type END AS description,
  count(*) AS packets, CAST(sum(payload_size) AS BIGINT) AS payload_bytes,
  count(*) FILTER (icmp_type = 8 AND icmp_code = 0) AS pings,
  count(*) FILTER (icmp_type = 0 AND icmp_code = 0) AS ping_replies, count(*) FILTER (icmp_type IN (3, 4, 5, 11, 12)) AS errors
FROM headers_fx WHERE protocol = 'ICMP' GROUP BY 1
""", ("headers_fx",))
def icmp_summary(spark, d):
    return op.icmp_summary(fx.view(spark, d, "headers_fx"))


@query("dns_summary", """
SELECT qname, count(*) AS questions, count(*) FILTER (dns_rcode = 0) AS noerror, count(*) FILTER (dns_rcode = 3) AS nxdomain,
  count(*) FILTER (dns_rcode NOT IN (0, 3)) AS anomalous
FROM (SELECT dns_query AS qname, dns_rcode FROM headers_fx WHERE dns_query IS NOT NULL
      UNION ALL SELECT 'www.' || dns_query, dns_rcode FROM headers_fx WHERE dns_query IS NOT NULL AND pid % 4 = 0)
GROUP BY qname
""", ("headers_fx",))
def dns_summary(spark, d):
    q = lambda name: F.struct(name.alias("qname"), F.lit(1).alias("qtype"), F.lit(1).alias("qclass"))
    name = F.col("dns_query")
    second = F.when(F.col("pid") % 4 == 0, q(F.concat(F.lit("www."), name)))
    df = fx.view(spark, d, "headers_fx").where(name.isNotNull())
    return op.dns_summary(df.withColumn("dns_queries", F.array_compact(F.array(q(name), second))))


@query("header_summary", f"""
SELECT protocol, {SERVICE} AS service, count(*) AS packets, round(avg(tcp_window), 6) AS avg_window,
  CAST(sum(tcp_options) AS BIGINT) AS options, max(tcp_seq) AS max_seq, round(avg(udp_length), 6) AS avg_length,
  count(*) FILTER (udp_checksum = 0) AS no_checksum
FROM headers_fx WHERE protocol IN ('TCP', 'UDP') GROUP BY 1, 2
""", ("headers_fx",))
def header_summary(spark, d):
    return op.header_summary(fx.view(spark, d, "headers_fx"))


@query("security_flag_counts", """
, f AS (
  SELECT src_ip, 'TCP_SCAN_' || CASE WHEN flags = 'F' THEN 'FIN' WHEN flags = '' THEN 'NULL' ELSE 'XMAS' END AS finding
  FROM headers_fx WHERE protocol = 'TCP' AND (flags IN ('', 'F') OR (flags LIKE '%F%' AND flags LIKE '%P%' AND flags LIKE '%U%' AND flags NOT LIKE '%A%'))
  UNION ALL SELECT src_ip, 'HIGH_PORT' FROM headers_fx WHERE dst_port > 1024
  UNION ALL SELECT src_ip, 'ICMP_TUNNEL' FROM headers_fx WHERE protocol = 'ICMP' AND payload_size > 64
  UNION ALL SELECT src_ip, 'DNS_ANOMALY' FROM headers_fx WHERE protocol = 'UDP' AND dns_rcode NOT IN (0, 3))
SELECT src_ip, finding, count(*) AS packets FROM f GROUP BY 1, 2
""", ("headers_fx",))
def security_flag_counts(spark, d):
    return op.security_flag_counts(fx.view(spark, d, "headers_fx"))


@query("capture_stats", """
SELECT count(*) AS total_packets, CAST(sum(packet_size) AS BIGINT) AS bytes_captured,
  count(*) FILTER (protocol = 'TCP') AS tcp_packets, count(*) FILTER (protocol = 'UDP') AS udp_packets,
  count(*) FILTER (protocol = 'ICMP') AS icmp_packets, count(*) FILTER (protocol = 'ARP') AS arp_packets,
  round(count(*) FILTER (protocol = 'TCP') * 100.0::DOUBLE / count(*), 6) AS tcp_percentage,
  round(count(*) FILTER (protocol = 'UDP') * 100.0::DOUBLE / count(*), 6) AS udp_percentage,
  round(count(*) FILTER (protocol = 'ICMP') * 100.0::DOUBLE / count(*), 6) AS icmp_percentage,
  round(count(*) FILTER (protocol = 'ARP') * 100.0::DOUBLE / count(*), 6) AS arp_percentage,
  round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS capture_rate,
  least(count(*), 1000) AS buffer_usage, round(least(count(*), 1000) * 100.0::DOUBLE / 1000, 6) AS buffer_percentage
FROM packets
""", ("packets",))
def capture_stats(spark, d):
    return op.capture_stats(fx.packets(spark, d))


@query("protocol_distribution", """
SELECT protocol, count(*) AS packets, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  CASE WHEN protocol IN ('TCP', 'UDP', 'ICMP') THEN protocol ELSE 'Other' END AS chart_bucket
FROM packets GROUP BY protocol
""", ("packets",))
def protocol_distribution(spark, d):
    return op.protocol_distribution(fx.packets(spark, d))


@query("top_ports", """
SELECT port, count(*) AS uses FROM (SELECT src_port AS port FROM packets UNION ALL SELECT dst_port FROM packets)
WHERE port IS NOT NULL GROUP BY port ORDER BY uses DESC, port LIMIT 10
""", ("packets",))
def top_ports(spark, d):
    return op.top_ports(fx.packets(spark, d))


@query("recent_packets", """
SELECT pid, ts_us, src_ip, dst_ip, protocol FROM (SELECT * FROM packets ORDER BY ts_us DESC, pid DESC LIMIT 100)
WHERE protocol = 'TCP'
""", ("packets",))
def recent_packets(spark, d):
    return op.recent_packets(fx.packets(spark, d), 100, "tcp").select("pid", "ts_us", "src_ip", "dst_ip", "protocol")


@query("network_stats", """
, a AS (SELECT max(ts_us) AS t FROM packets),
c AS (SELECT DISTINCT protocol, least((src_ip, src_port), (dst_ip, dst_port)), greatest((src_ip, src_port), (dst_ip, dst_port))
      FROM packets, a WHERE protocol IN ('TCP', 'UDP') AND ts_us >= t - 300000000 AND src_port <> 0 AND dst_port <> 0)
SELECT max(ts_us) AS ts_us, count(*) AS total_packets, CAST(sum(packet_size) AS BIGINT) AS bytes_captured,
  round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS packets_per_second,
  round(sum(packet_size) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS bytes_per_second,
  (SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM (SELECT protocol AS p, count(*) AS n FROM packets GROUP BY 1)) AS protocol_distribution,
  (SELECT string_agg(p || '=' || n, ',' ORDER BY n DESC, p) FROM (SELECT src_ip AS p, count(*) AS n FROM packets GROUP BY 1 ORDER BY n DESC, p LIMIT 10)) AS top_src_ip,
  (SELECT string_agg(p || '=' || n, ',' ORDER BY n DESC, p) FROM (SELECT dst_ip AS p, count(*) AS n FROM packets GROUP BY 1 ORDER BY n DESC, p LIMIT 10)) AS top_dst_ip,
  (SELECT count(*) FROM c) AS active_connections
FROM packets
""", ("packets",))
def network_stats(spark, d):
    p = fx.packets(spark, d)
    out = op.network_stats(p, connections.active_connections(p, limit=None))
    pairs = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x["n"].cast("string"))), ",")
    entries = F.map_entries("protocol_distribution")
    return out.select(
        "ts_us", "total_packets", "bytes_captured", "packets_per_second", "bytes_per_second",
        F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
        .alias("protocol_distribution"),
        pairs(F.col("top_src_ip"), "value").alias("top_src_ip"),
        pairs(F.col("top_dst_ip"), "value").alias("top_dst_ip"), "active_connections",
    )


@query("traffic_timeseries", f"""
SELECT ts_us - ts_us % 60000000 AS interval_us,
  CAST(coalesce(sum(packet_size) FILTER ({DIRECTION} = 'inbound'), 0) AS BIGINT) AS inbound_bytes,
  CAST(coalesce(sum(packet_size) FILTER ({DIRECTION} = 'outbound'), 0) AS BIGINT) AS outbound_bytes,
  count(*) FILTER ({DIRECTION} = 'inbound') AS inbound_packets,
  count(*) FILTER ({DIRECTION} = 'outbound') AS outbound_packets
FROM packets GROUP BY 1
""", ("packets",))
def traffic_timeseries(spark, d):
    return op.traffic_timeseries(fx.packets(spark, d))
