"""Log entries: structured events, search, statistics, archive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import SECOND
from flowlantern.functions.net import round6
from flowlantern.sources.sinks import write_by_date


def with_details(logs: DataFrame) -> DataFrame:
    """``details`` from JSON text to a map."""
    return logs.withColumn("details", F.coalesce(F.from_json("details", "map<string,string>"), F.create_map().cast("map<string,string>")))


def structured_events(logs: DataFrame, event_type: Column, extra: dict[str, Column]) -> DataFrame:
    """Entries whose details carry the event type and extra fields; later fields replace earlier ones of that name."""
    added = F.create_map(F.lit("event_type"), event_type, *[x for k, c in extra.items() for x in (F.lit(k), c.cast("string"))])
    names = F.array(F.lit("event_type"), *[F.lit(k) for k in extra])
    kept = F.map_filter("details", lambda k, v: ~F.array_contains(names, k))
    return logs.select("log_id", "ts_us", F.upper("level").alias("level"), "component", "message",
                       F.map_concat(kept, added).alias("details"), "source_ip")


def log_search(logs: DataFrame, text: str, level: str | None = None, component: str | None = None,
               start_us: int | None = None, end_us: int | None = None, source_ip: str | None = None,
               limit: int = 1000) -> DataFrame:
    """Case-insensitive pattern search over message and details; the newest ``limit`` hits.

    The cheap column filters come first in the plan, so that they reach the scan.
    """
    try:
        re.compile(text)
    except re.error:
        text = re.escape(text)
    for cond in (
        level and F.col("level") == level.upper(), component and F.col("component") == component,
        F.col("ts_us") >= start_us if start_us is not None else None,
        F.col("ts_us") <= end_us if end_us is not None else None,
        source_ip and F.col("source_ip") == source_ip,
    ):
        if cond is not None:
            logs = logs.where(cond)
    hit = F.concat_ws(" ", "message", "details").rlike("(?i)" + text)
    return logs.where(hit).orderBy(F.desc("ts_us"), F.desc("log_id")).limit(limit)


def log_stats(logs: DataFrame, k: int = 10) -> DataFrame:
    """Counts by level, component and source (top k), plus a total row with time span and recent errors."""
    a = logs.withColumn("as_of", logs.agg(F.max("ts_us")).scalar())
    bad = F.col("level").isin("ERROR", "CRITICAL") & (F.col("as_of") - F.col("ts_us") <= 3600 * SECOND)
    dims = F.explode(F.array(
        F.struct(F.lit("level").alias("dimension"), F.col("level").alias("value")),
        *[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in (
            ("component", F.col("component")), ("source_ip", F.col("source_ip")), ("total", F.lit("all")))])).alias("x")
    g = a.select("ts_us", bad.alias("bad"), dims).where(F.col("x.value").isNotNull()).groupBy("x.dimension", "x.value").agg(
        F.count("*").alias("entries"), F.count_if("bad").alias("recent_errors"),
        round6((F.max("ts_us") - F.min("ts_us")) / (3600 * SECOND)).alias("span_hours"))
    top = g.where(F.col("dimension") == "source_ip").orderBy(F.desc("entries"), "value").limit(k)
    rows = g.where(F.col("dimension") != "source_ip").unionByName(top)
    total = F.col("dimension") == "total"
    return rows.select("dimension", "value", "entries", F.when(total, F.col("recent_errors")).alias("recent_errors"),
                       F.when(total, F.col("span_hours")).alias("span_hours"))


def recent_logs(logs: DataFrame, n: int = 100, level: str | None = None, component: str | None = None) -> DataFrame:
    """The last ``n`` entries, then the filters."""
    out = logs.orderBy(F.desc("ts_us"), F.desc("log_id")).limit(n)
    if level:
        out = out.where(F.col("level") == level.upper())
    return out.where(F.col("component") == component) if component else out


def archive_logs(logs: DataFrame, path: str, cutoff_us: int) -> DataFrame:
    """Appends entries older than the cutoff to the date-partitioned archive; returns the ones that stay."""
    write_by_date(logs.where(F.col("ts_us") < cutoff_us), path)
    return logs.where(F.col("ts_us") >= cutoff_us)
