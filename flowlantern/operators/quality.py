"""Validation: named rules as columns, violations as data, cleaning of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import SECOND
from flowlantern.functions.net import is_valid_ip

# ---- fixed values: enumerations -----------------------------------------------------------------
PROTOCOLS = ["TCP", "UDP", "ICMP", "ARP", "UNKNOWN"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
STATUSES = ["NEW", "ACKNOWLEDGED", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE"]
ATTACK_TYPES = [
    "port_scan", "dos", "brute_force", "dns_amplification", "malware", "tunneling", "suspicious", "anomaly_detection",
    "unknown",
]


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``: the names of the rules a row breaks. A rule that evaluates to null is broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def valid_port(c: Column) -> Column:
    return c.isNull() | c.between(0, 65535)


def validate_packets(df: DataFrame) -> DataFrame:
    return violations(df, {
        "src_ip": is_valid_ip(F.col("src_ip")), "dst_ip": is_valid_ip(F.col("dst_ip")),
        "protocol": F.upper("protocol").isin(PROTOCOLS),
        "src_port": valid_port(F.col("src_port")), "dst_port": valid_port(F.col("dst_port")),
        "sizes": (F.col("packet_size") >= 0) & (F.col("payload_size") >= 0),
    })


NON_NEGATIVE = [
    "packet_count", "byte_count", "duration", "packets_per_second", "bytes_per_second", "avg_inter_arrival_time",
    "std_inter_arrival_time", "avg_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
    "src_to_dst_packets", "dst_to_src_packets", "src_to_dst_bytes", "dst_to_src_bytes", "burstiness",
]
UNIT_RANGE = ["port_scan_indicator", "syn_flood_ratio", "regularity"]


def validate_flows(df: DataFrame) -> DataFrame:
    rules = {c: F.col(c) >= 0 for c in NON_NEGATIVE}
    rules |= {c: F.col(c).between(0, 1) for c in UNIT_RANGE}
    rules["protocol"] = F.upper("protocol").isin(PROTOCOLS)
    return violations(df, rules)


def valid_time(ts_us: Column, as_of_us: Column) -> Column:
    return (ts_us > 0) & (ts_us <= as_of_us + 86_400 * SECOND)


def clean_text(c: Column, max_length: int = 255) -> Column:
    """Without markup characters, quotes and control characters, cut to the length of the text column."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[<>\"'\\x00-\\x1f\\x7f-\\x9f]", ""), 1, max_length)


def validate_alerts(df: DataFrame, as_of_us: Column) -> DataFrame:
    """Enumerations are normalised first: priority upper case, attack type lower case."""
    df = df.withColumns({"priority": F.upper("priority"), "attack_type": F.lower("attack_type")})
    return violations(df, {
        "priority": F.col("priority").isin(SEVERITIES), "status": F.col("status").isin(STATUSES),
        "attack_type": F.col("attack_type").isin(ATTACK_TYPES), "confidence": F.col("confidence").between(0, 1),
        "timestamp": valid_time(F.col("ts_us"), as_of_us), "source_ip": F.col("source_ip").isNotNull(),
    })


def validate_detections(df: DataFrame, as_of_us: Column) -> DataFrame:
    return violations(df, {
        "confidence": F.col("confidence").between(0, 1), "anomaly_score": F.col("anomaly_score").between(0, 1),
        "timestamp": valid_time(F.col("ts_us"), as_of_us), "detection_method": F.col("detection_method").isNotNull(),
    })


def validate_matches(df: DataFrame, as_of_us: Column) -> DataFrame:
    return violations(df, {
        "severity": F.col("severity").isin(SEVERITIES), "confidence": F.col("confidence").between(0, 1),
        "timestamp": valid_time(F.col("ts_us"), as_of_us), "source_ip": is_valid_ip(F.col("source_ip")),
        "target_ip": is_valid_ip(F.col("target_ip")),
    })
