"""Notifications as data: rendered messages per channel, delivery statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.config import SECOND
from flowlantern.functions.net import ratio, round6


@dataclass(frozen=True)
class Channel:
    name: str
    enabled: bool = True


DEFAULT_CHANNELS = [Channel("syslog"), Channel("console"), Channel("file"), Channel("email", False), Channel("webhook", False)]


def fan_out(alerts: DataFrame, channels: list[Channel] | None = None, product: str = "IDS") -> DataFrame:
    """One row per (alert, enabled channel) with the text that channel sends. No join: the channels are a literal."""
    names = [c.name for c in (DEFAULT_CHANNELS if channels is None else channels) if c.enabled]
    p, kind = F.col("priority"), F.upper("attack_type")
    level = F.when(p == "LOW", "INFO").when(p == "HIGH", "ERR").when(p == "CRITICAL", "CRIT").otherwise("WARNING")
    subject = F.format_string(f"[{product} ALERT] %s: %s", p, kind)
    line = F.format_string(
        f"{product} Alert [%s] %s: Source: %s, Target: %s, Confidence: %s%%, ID: %s", p, kind, F.col("source_ip"),
        F.coalesce("target_ip", F.lit("N/A")), F.format_string("%.2f", F.col("confidence") * 100),
        F.col("alert_id").cast("string"))
    payload = F.to_json(F.struct(
        F.col("alert_id"), F.col("ts_us").alias("timestamp"), "priority", "status", "source_ip", "target_ip",
        "attack_type", "confidence", "source"))
    ch = F.col("channel")
    return alerts.withColumn("channel", F.explode(F.array(*[F.lit(n) for n in names]))).select(
        "alert_id", "ts_us", "channel", level.alias("level"), subject.alias("subject"),
        F.when(ch == "syslog", line).when(ch.isin("file", "webhook"), payload).otherwise(subject).alias("message"))


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    """Per channel and overall (channel null): deliveries, successes, success rate, failures of the last hour."""
    d = deliveries.withColumn("as_of", deliveries.agg(F.max("ts_us")).scalar())
    n, ok = F.count("*"), F.count_if("success")
    return d.rollup("channel").agg(
        n.alias("total"), ok.alias("successful"), round6(ratio(ok * 100.0, n)).alias("success_rate"),
        F.count_if(~F.col("success") & (F.col("as_of") - F.col("ts_us") <= 3600 * SECOND)).alias("recent_failures"))


def delivery_history(deliveries: DataFrame, n: int = 100) -> DataFrame:
    return deliveries.orderBy(F.desc("ts_us"), F.desc("alert_id"), "channel").limit(n)
