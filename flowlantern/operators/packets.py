"""Packet-level projections and plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net

RECENT = 1000  # size of the capture ring; "recent packets" is a top-k by time


def protocol_label(ip_version: Column, l4_protocol: Column, arp_op: Column) -> Column:
    """Protocol of a decoded packet: the first of TCP, UDP, ICMP under IP, else ARP, else UNKNOWN."""
    return (
        F.when(ip_version.isNotNull() & l4_protocol.isin(6, 17, 1),
               F.when(l4_protocol == 6, "TCP").when(l4_protocol == 17, "UDP").otherwise("ICMP"))
        .when(arp_op.isNotNull(), "ARP").otherwise("UNKNOWN")
    )


def scan_packets(df: DataFrame) -> DataFrame:
    """Normalised packet records: upper-case protocol, no ports outside TCP and UDP."""
    has_ports = F.upper("protocol").isin("TCP", "UDP")
    return df.select(
        "pid", "ts_us", "src_ip", "dst_ip",
        F.when(has_ports, F.col("src_port")).alias("src_port"),
        F.when(has_ports, F.col("dst_port")).alias("dst_port"),
        F.upper("protocol").alias("protocol"), "packet_size", "payload_size", "flags", "ttl",
    )


def capture_filter(df: DataFrame, condition: str) -> DataFrame:
    """Source-side filter, given as a SQL condition that Catalyst can push into the scan."""
    return df.where(condition)


def packet_features(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Per-packet features: sizes, ports with 0 for none, flag tests (TCP only) and classifications."""
    tcp = F.upper("protocol") == "TCP"
    flags = F.col("flags")
    src_in, dst_in = (net.is_internal_ip(F.col(c), th.internal_cidrs) for c in ("src_ip", "dst_ip"))
    return df.select(
        "pid", "ts_us", "packet_size", "payload_size",
        net.port_or_zero(F.col("src_port")).alias("src_port"),
        net.port_or_zero(F.col("dst_port")).alias("dst_port"),
        "protocol", "ttl", F.length(flags).alias("flag_count"),
        *[(tcp & net.has_flag(flags, x)).alias(n) for x, n in
          (("S", "is_syn"), ("A", "is_ack"), ("F", "is_fin"), ("R", "is_rst"), ("P", "is_psh"))],
        src_in.alias("is_internal_src"), dst_in.alias("is_internal_dst"),
        (src_in != dst_in).alias("is_cross_boundary"),
        (net.is_well_known_port(F.col("src_port")) | net.is_well_known_port(F.col("dst_port")))
        .alias("is_well_known_port"),
    )


def direction(th: Thresholds = DEFAULTS) -> Column:
    s, d = (net.is_internal_ip(F.col(c), th.internal_cidrs) for c in ("src_ip", "dst_ip"))
    return (
        F.when(s & ~d, "outbound").when(~s & d, "inbound").when(s & d, "internal").otherwise("external")
    )


def bucket_start(width_us: int, ts: str = "ts_us") -> Column:
    """Start of the epoch-aligned bucket, in microseconds."""
    return F.col(ts) - F.pmod(F.col(ts), F.lit(width_us))


def cross_boundary_bytes(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Packets and bytes by direction and 10-second window."""
    return df.groupBy(bucket_start(th.window_us).alias("window_us"), direction(th).alias("direction")).agg(
        F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"),
    )


def service_traffic(df: DataFrame) -> DataFrame:
    """Packets and bytes per service of the destination port."""
    return (
        df.where(F.col("protocol").isin("TCP", "UDP"))
        # group by the narrow integer key first; the names are attached to the few groups left
        .groupBy("protocol", "dst_port")
        .agg(F.count("*").alias("n"), F.sum("packet_size").alias("b"))
        .groupBy("protocol", net.service_name(F.col("protocol"), F.col("dst_port")).alias("service"))
        .agg(F.sum("n").alias("packets"), F.sum("b").alias("bytes"))
    )


def tcp_state_counts(df: DataFrame) -> DataFrame:
    """TCP packets per destination and state implied by the flags."""
    return (
        df.where(F.col("protocol") == "TCP")
        .groupBy("dst_ip", net.tcp_state(F.col("flags")).alias("state"))
        .agg(F.count("*").alias("packets"))
    )


def scan_types_by_source(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("protocol") == "TCP")
        .withColumn("scan_type", net.tcp_scan_type(F.col("flags")))
        .where(F.col("scan_type").isNotNull())
        .groupBy("src_ip", "scan_type")
        .agg(F.count("*").alias("packets"), F.count_distinct("dst_ip").alias("targets"))
    )


def icmp_summary(df: DataFrame) -> DataFrame:
    """ICMP packets by description, with ping, reply and error counts."""
    t = F.col("icmp_type")
    return (
        df.where(F.col("protocol") == "ICMP")
        .groupBy(net.icmp_description(t, F.col("icmp_code")).alias("description"))
        .agg(
            F.count("*").alias("packets"), F.sum("payload_size").alias("payload_bytes"),
            F.count_if((t == 8) & (F.col("icmp_code") == 0)).alias("pings"),
            F.count_if((t == 0) & (F.col("icmp_code") == 0)).alias("ping_replies"), F.count_if(t.isin(3, 4, 5, 11, 12)).alias("errors"),
        )
    )


def dns_questions(df: DataFrame) -> DataFrame:
    """One row per question of a DNS packet (``dns.queries`` exploded; packets without one keep a null)."""
    return df.select("pid", "ts_us", "src_ip", "dns_rcode", F.explode_outer("dns_queries").alias("q")).select(
        "pid", "ts_us", "src_ip", "dns_rcode", F.col("q.qname").alias("qname"), F.col("q.qtype").alias("qtype"),
        F.col("q.qclass").alias("qclass"),
    )


def dns_summary(df: DataFrame) -> DataFrame:
    """Questions per name and the mix of response codes."""
    return dns_questions(df).where(F.col("qname").isNotNull()).groupBy("qname").agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("dns_rcode") == 0).alias("noerror"),
        F.count_if(F.col("dns_rcode") == 3).alias("nxdomain"),
        F.count_if(~F.col("dns_rcode").isin(0, 3)).alias("anomalous"),
    )


def header_summary(df: DataFrame) -> DataFrame:
    """Transport header numbers per service."""
    return (
        df.where(F.col("protocol").isin("TCP", "UDP"))
        .groupBy("protocol", net.service_name(F.col("protocol"), F.col("dst_port")).alias("service"))
        .agg(
            F.count("*").alias("packets"),
            net.round6(F.avg("tcp_window")).alias("avg_window"),
            F.sum("tcp_options").alias("options"),
            F.max("tcp_seq").alias("max_seq"),
            net.round6(F.avg("udp_length")).alias("avg_length"),
            F.count_if(F.col("udp_checksum") == 0).alias("no_checksum"),
        )
    )


def security_flag_counts(df: DataFrame) -> DataFrame:
    """Findings per source."""
    return (
        df.select("src_ip", F.explode(net.security_flags(F.col("dns_rcode"))).alias("finding"))
        .groupBy("src_ip", "finding").agg(F.count("*").alias("packets"))
    )


def capture_stats(df: DataFrame, ring: int = RECENT) -> DataFrame:
    """Totals, per-protocol counts and percentages, rate over the captured span, ring fill."""
    p = F.upper("protocol")
    total = F.count("*")
    out = df.agg(
        total.alias("total_packets"), F.sum("packet_size").alias("bytes_captured"),
        *[F.count_if(p == x).alias(f"{x.lower()}_packets") for x in ("TCP", "UDP", "ICMP", "ARP")],
        ((F.max("ts_us") - F.min("ts_us")) / SECOND).alias("elapsed"),
    )
    n = F.col("total_packets")
    return out.select(
        "total_packets", "bytes_captured", "tcp_packets", "udp_packets", "icmp_packets", "arp_packets",
        *[net.round6(net.ratio(F.col(f"{x}_packets") * 100.0, n)).alias(f"{x}_percentage")
          for x in ("tcp", "udp", "icmp", "arp")],
        net.round6(net.ratio(n, F.col("elapsed"))).alias("capture_rate"),
        F.least(n, F.lit(ring)).alias("buffer_usage"),
        net.round6(F.least(n, F.lit(ring)) * 100.0 / ring).alias("buffer_percentage"),
    )


def protocol_distribution(df: DataFrame) -> DataFrame:
    """Count and share per protocol."""
    counts = df.groupBy(F.upper("protocol").alias("protocol")).agg(F.count("*").alias("packets"))
    total = counts.agg(F.sum("packets")).scalar()
    return counts.select(
        "protocol", "packets", net.round6(net.ratio(F.col("packets"), total)).alias("share"),
        F.when(F.col("protocol").isin("TCP", "UDP", "ICMP"), F.col("protocol")).otherwise("Other").alias("chart_bucket"),
    )


def top_ports(df: DataFrame, k: int = 10) -> DataFrame:
    return (
        df.select(F.explode(F.array("src_port", "dst_port")).alias("port"))
        .where(F.col("port").isNotNull())
        .groupBy("port").agg(F.count("*").alias("uses"))
        .orderBy(F.desc("uses"), "port").limit(k)
    )


def recent_packets(df: DataFrame, n: int = 100, protocol: str | None = None) -> DataFrame:
    """The last ``n`` packets; the protocol filter applies after the cut."""
    out = df.orderBy(F.desc("ts_us"), F.desc("pid")).limit(n)
    return out.where(F.upper("protocol") == protocol.upper()) if protocol else out


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """One row with the k most frequent values as an ordered array of (value, n)."""
    top = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    top = top.orderBy(F.desc("n"), "value").limit(k)
    return top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))),
            lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n")),
        ).alias(f"top_{col}")
    )


def network_stats(df: DataFrame, active_connections: DataFrame) -> DataFrame:
    """The dashboard row. ``active_connections`` is the connection table at the same moment."""
    totals = df.agg(
        F.max("ts_us").alias("ts_us"), F.count("*").alias("total_packets"),
        F.sum("packet_size").alias("bytes_captured"),
        ((F.max("ts_us") - F.min("ts_us")) / SECOND).alias("elapsed"),
    )
    dist = (
        df.groupBy(F.upper("protocol").alias("p")).agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("protocol_distribution"))
    )
    return totals.select(
        "ts_us", "total_packets", "bytes_captured",
        net.round6(net.ratio(F.col("total_packets"), F.col("elapsed"))).alias("packets_per_second"),
        net.round6(net.ratio(F.col("bytes_captured"), F.col("elapsed"))).alias("bytes_per_second"),
        dist.scalar().alias("protocol_distribution"),
        top_values(df, "src_ip").scalar().alias("top_src_ip"), top_values(df, "dst_ip").scalar().alias("top_dst_ip"),
        active_connections.agg(F.count("*")).scalar().alias("active_connections"),
    )


def traffic_timeseries(df: DataFrame, interval_us: int = 60 * SECOND, th: Thresholds = DEFAULTS) -> DataFrame:
    """Inbound and outbound bytes and packets per interval."""
    d = direction(th)
    return df.groupBy(bucket_start(interval_us).alias("interval_us")).agg(
        *[F.sum(F.when(d == way, F.col("packet_size")).otherwise(0)).alias(f"{way}_bytes")
          for way in ("inbound", "outbound")],
        *[F.count_if(d == way).alias(f"{way}_packets") for way in ("inbound", "outbound")],
    )
