"""Aggregates, patterns and scores per epoch-aligned 10-second window.

Everything is derived from one pre-aggregation, the *conversations* of a window: packets, bytes and odd flag sets
per (window, 5-tuple), built with map-side combine. The full feature row comes from one scan: each conversation is
seen as a part of its target, its source and its ports, and three more aggregations, each far smaller than the one
before, count and rank those entities. So a window holding a large share of all packets costs no single task more than
its share of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net
from flowlantern.operators.packets import bucket_start


def conversations(df: DataFrame, th: Thresholds = DEFAULTS, by: Column | None = None, *more: Column) -> DataFrame:
    """One row per window and 5-tuple. ``by`` replaces the window column, for streams; ``more`` are further aggregates."""
    odd = (F.col("protocol") == "TCP") & (
        (F.col("flags") == "") | net.flags_are(F.col("flags"), "F") | net.flags_are(F.col("flags"), "FPU")
    )
    return df.groupBy(
        bucket_start(th.window_us).alias("window_us") if by is None else by, "src_ip", "dst_ip",
        *[net.port_or_zero(F.col(c)).alias(c) for c in ("src_port", "dst_port")],
        F.upper("protocol").alias("protocol"),
    ).agg(
        F.count("*").alias("n"), F.sum("packet_size").alias("b"), F.count_if(odd).alias("odd"), *more,
    )


def _seconds(th: Thresholds) -> float:
    return th.window_us / SECOND


def _totals(conv: DataFrame, th: Thresholds) -> DataFrame:
    src_in, dst_in = (net.is_internal_ip(F.col(c), th.internal_cidrs) for c in ("src_ip", "dst_ip"))
    return conv.groupBy("window_us").agg(
        F.sum("n").alias("total_packets"), F.sum("b").alias("total_bytes"), F.count("*").alias("flow_keys"),
        *[F.sum(F.when(F.col("protocol") == p, F.col("n")).otherwise(0)).alias(f"{p.lower()}_packets")
          for p in ("TCP", "UDP", "ICMP", "ARP")],
        F.sum(F.when(src_in & ~dst_in, F.col("b")).otherwise(0)).alias("outbound_bytes"),
        F.sum("odd").alias("odd_packets"),
    )


def _destinations(conv: DataFrame) -> DataFrame:
    per_dst = conv.groupBy("window_us", "dst_ip").agg(F.sum("n").alias("n"))
    return per_dst.groupBy("window_us").agg(
        F.count("*").alias("unique_destinations"), F.max("n").alias("max_dst_packets")
    )


def _sources(conv: DataFrame, th: Thresholds) -> DataFrame:
    cross = net.is_internal_ip(F.col("src_ip"), th.internal_cidrs) != net.is_internal_ip(
        F.col("dst_ip"), th.internal_cidrs)
    per_port = conv.groupBy("window_us", "src_ip", "dst_port").agg(F.max(cross).alias("cross"))
    per_src = per_port.groupBy("window_us", "src_ip").agg(F.count_if("cross").alias("ports"))
    return per_src.groupBy("window_us").agg(
        F.count("*").alias("unique_sources"), F.max("ports").alias("max_src_ports")
    )


_SUMS = ["n", "b", "odd", "flow_keys", "outbound", "tcp", "udp", "icmp", "arp"]


def window_measures(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Every plain measure of a window from one scan."""
    return measures(conversations(df, th), th)


def measures(conv: DataFrame, th: Thresholds = DEFAULTS, by: str = "window_us", more: tuple[str, ...] = ()) -> DataFrame:
    """The measures of each window ``by`` from its conversations; ``more`` are further columns to add up."""
    src_in, dst_in = (net.is_internal_ip(F.col(c), th.internal_cidrs) for c in ("src_ip", "dst_ip"))
    conv = conv.withColumns({
        "cross": src_in != dst_in, "outbound": F.when(src_in & ~dst_in, F.col("b")).otherwise(0),
        "flow_keys": F.lit(1).cast("bigint"),
        **{p: F.when(F.col("protocol") == p.upper(), F.col("n")).otherwise(0) for p in ("tcp", "udp", "icmp", "arp")},
    })
    none, sums = F.lit(None), [*_SUMS, *more]

    def entity(kind: str, name: Column, part: Column, counted: bool) -> Column:
        # the sums of a window ride on its targets alone, so that they are counted once
        return F.struct(
            F.lit(kind).alias("kind"), name.cast("string").alias("name"), part.cast("int").alias("part"),
            *[(F.col(c) if counted else none).cast("bigint").alias(c) for c in sums])

    rows = conv.select(by, "cross", F.explode(F.array(
        entity("target", F.col("dst_ip"), none, True), entity("source", F.col("src_ip"), F.col("dst_port"), False),
        entity("port", F.col("src_port"), none, False), entity("port", F.col("dst_port"), none, False))).alias("x"))
    rows = rows.select(by, "cross", "x.*").where("kind <> 'port' OR name <> '0'")
    parts = rows.groupBy(by, "kind", "name", "part").agg(
        F.max("cross").alias("cross"), *[F.sum(c).alias(c) for c in sums])
    names = parts.groupBy(by, "kind", "name").agg(
        F.count_if("cross").alias("cross_ports"), *[F.sum(c).alias(c) for c in sums])
    kind = F.col("kind")
    return names.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(kind == "source").alias("unique_sources"), F.count_if(kind == "target").alias("unique_destinations"),
        F.count_if(kind == "port").alias("unique_ports"),
        F.max(F.when(kind == "target", F.col("n"))).alias("max_dst_packets"),
        F.max(F.when(kind == "source", F.col("cross_ports"))).alias("max_src_ports"),
    )


def window_aggregates(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Packets, bytes, distinct sources, destinations and ports."""
    return window_measures(df, th).select(
        "window_us", F.col("n").alias("total_packets"), F.col("b").alias("total_bytes"), "unique_sources",
        "unique_destinations", "unique_ports")


def window_protocol_ratios(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Share of each protocol, as a map."""
    per = df.groupBy(bucket_start(th.window_us).alias("window_us"), F.upper("protocol").alias("protocol")).agg(
        F.count("*").alias("n"))
    g = per.groupBy("window_us").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("protocol", "n"))).alias("parts")
    )  # a handful of protocols per window
    return g.select("window_us", F.map_from_entries(F.transform(
        "parts", lambda x: F.struct(x["protocol"], x["n"] / F.col("total")))).alias("protocol_ratios"))


def _flow_durations(flows: DataFrame, th: Thresholds) -> DataFrame:
    """Mean duration of the flows that end in the window: the range condition becomes an equality on the bucket."""
    return flows.groupBy(bucket_start(th.window_us, "end_us").alias("window_us")).agg(
        (F.avg(F.col("end_us") - F.col("start_us")) / SECOND).alias("avg_flow_duration"))


def window_flow_patterns(df: DataFrame, flows: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    totals = _totals(conversations(df, th), th)
    return totals.join(_flow_durations(flows, th), "window_us", "left").select(
        "window_us", (F.col("flow_keys") / _seconds(th)).alias("new_flows_per_second"),
        (F.col("flow_keys") / F.col("total_packets")).alias("flow_diversity"),
        F.coalesce("avg_flow_duration", F.lit(0.0)).alias("avg_flow_duration"),
    )


def scan_score(ports: Column, th: Thresholds) -> Column:
    return F.when(ports > th.scan_ports_min, F.least(ports / th.scan_ports_full, F.lit(1.0))).otherwise(0.0)


def dos_score(rate: Column, th: Thresholds) -> Column:
    return F.when(rate > th.dos_rate_min, F.least(rate / th.dos_rate_full, F.lit(1.0))).otherwise(0.0)


def exfil_score(out_bytes: Column, th: Thresholds) -> Column:
    return F.when(out_bytes > th.exfil_bytes_min, F.least(out_bytes / th.exfil_bytes_full, F.lit(1.0))).otherwise(0.0)


def unusual_score(icmp: Column, total: Column, odd: Column, th: Thresholds) -> Column:
    return ((icmp / total > th.icmp_share_max).cast("int") + (odd > 0).cast("int")) / 2.0


def port_scan_scores(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Largest number of distinct destination ports one source touched across the boundary, scored."""
    return _sources(conversations(df, th), th).select(
        "window_us", "max_src_ports", scan_score(F.col("max_src_ports"), th).alias("port_scan_score"))


def dos_scores(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    rate = F.col("max_dst_packets") / _seconds(th)
    return _destinations(conversations(df, th)).select(
        "window_us", rate.alias("max_rate"), dos_score(rate, th).alias("dos_score"))


def exfiltration_scores(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return _totals(conversations(df, th), th).select(
        "window_us", "outbound_bytes", exfil_score(F.col("outbound_bytes"), th).alias("data_exfiltration_score"))


def unusual_protocol_scores(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    t = _totals(conversations(df, th), th)
    return t.select("window_us", unusual_score(
        F.col("icmp_packets"), F.col("total_packets"), F.col("odd_packets"), th).alias("unusual_protocol_score"))


def window_features(df: DataFrame, flows: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Every aggregate, pattern, ratio and score of a window in one row."""
    return feature_row(window_measures(df, th).join(_flow_durations(flows, th), "window_us", "left"), th)


def feature_row(rows: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Features from measures and ``avg_flow_duration``; shared with the streaming form."""
    n = F.col("n")
    return rows.select(
        "window_us", n.alias("total_packets"), F.col("b").alias("total_bytes"), "unique_sources", "unique_destinations",
        "unique_ports", (F.col("flow_keys") / _seconds(th)).alias("new_flows_per_second"),
        F.coalesce("avg_flow_duration", F.lit(0.0)).alias("avg_flow_duration"),
        (F.col("flow_keys") / n).alias("flow_diversity"),
        scan_score(F.col("max_src_ports"), th).alias("port_scan_score"),
        dos_score(F.col("max_dst_packets") / _seconds(th), th).alias("dos_score"),
        exfil_score(F.col("outbound"), th).alias("data_exfiltration_score"),
        unusual_score(F.col("icmp"), n, F.col("odd"), th).alias("unusual_protocol_score"),
        *[(F.col(p) / n).alias(f"{p}_ratio") for p in ("tcp", "udp", "icmp", "arp")],
    )


WINDOW_VECTOR = [
    "total_packets", "total_bytes", "unique_sources", "unique_destinations", "unique_ports", "new_flows_per_second",
    "avg_flow_duration", "flow_diversity", "port_scan_score", "dos_score", "data_exfiltration_score",
    "unusual_protocol_score", "tcp_ratio", "udp_ratio", "icmp_ratio",
]


def window_vector(features: DataFrame) -> DataFrame:
    return features.select("window_us", *[F.col(c).cast("double").alias(c) for c in WINDOW_VECTOR])
