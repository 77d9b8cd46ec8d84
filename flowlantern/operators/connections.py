"""TCP connections and UDP sessions: direction-free keys, closed by 300 s of silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net
from flowlantern.operators.sessions import session_starts, slices

FLAG_LETTERS = "SAFRPUEC"


def _flag_mask(flags: Column) -> Column:
    mask = F.lit(0)
    for i, x in enumerate(FLAG_LETTERS):
        mask = mask.bitwiseOR(F.when(net.has_flag(flags, x), 1 << i).otherwise(0))
    return mask


def _mask_letters(mask: Column) -> Column:
    letters = [F.when(mask.bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(FLAG_LETTERS)]
    return F.array_sort(F.array_compact(F.array(*letters)))


def connections(df: DataFrame, protocol: str, th: Thresholds = DEFAULTS) -> DataFrame:
    """One row per (end points, idle session). The first packet fixes the direction, the last one the state."""
    lo, hi = net.connection_key()
    order = F.struct("ts_us", "pid")
    rows = df.where((F.col("protocol") == protocol) & (F.col("src_port") != 0) & (F.col("dst_port") != 0)).select(
        "ts_us", "pid", "packet_size", lo.alias("lo"), hi.alias("hi"), "flags",
        F.struct("src_ip", "src_port", "dst_ip", "dst_port").alias("ends"),
    )
    gap = th.connection_idle_us
    sl = slices(rows, ["lo", "hi"], gap, [
        F.count("*").alias("n"), F.sum("packet_size").alias("b"), F.bit_or(_flag_mask(F.col("flags"))).alias("mask"),
        F.min(F.struct("ts_us", "pid", "ends")).alias("head"),
        F.max(F.struct("ts_us", "pid", "flags")).alias("tail"),
    ])
    out = session_starts(sl, ["lo", "hi"], gap).groupBy("lo", "hi", "session_us").agg(
        F.sum("n").alias("packet_count"), F.sum("b").alias("byte_count"), F.bit_or("mask").alias("mask"),
        F.min("head").alias("head"), F.max("tail").alias("tail"),
    )
    cols = [
        F.lit(protocol).alias("protocol"),
        *[F.col(f"head.ends.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")],
        F.col("head.ts_us").alias("start_us"), F.col("tail.ts_us").alias("last_us"),
        net.round6((F.col("tail.ts_us") - F.col("head.ts_us")) / SECOND).alias("duration"),
        "packet_count", "byte_count",
    ]
    if protocol == "TCP":
        cols += [net.tcp_state(F.col("tail.flags")).alias("state"), _mask_letters(F.col("mask")).alias("flags_seen")]
    return out.select(*cols)


def tcp_connections(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return connections(df, "TCP", th)


def udp_sessions(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return connections(df, "UDP", th)


def latest(df: DataFrame, ts: str = "ts_us") -> Column:
    """The newest time in the input, the default "now" of every report, as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()


def connection_stats(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Counts over the connections alive at the newest packet, and the number of TCP connections already expired."""
    tcp = tcp_connections(df, th).withColumn("as_of", latest(df))
    alive = F.col("last_us") >= F.col("as_of") - th.connection_idle_us
    age = (F.col("as_of") - F.col("start_us")) / SECOND
    tcp_row = tcp.agg(
        F.count_if(alive).alias("tcp_connections"),
        F.count_if(alive & (F.col("state") == "ESTABLISHED")).alias("established"),
        F.count_if(alive & F.col("state").isin("SYN_SENT", "SYN_RECEIVED")).alias("connecting"),
        F.count_if(alive & F.col("state").isin("CLOSED", "RESET")).alias("closing"),
        F.coalesce(net.round6(F.avg(F.when(alive, age))), F.lit(0.0)).alias("avg_duration"),
        F.count_if(~alive).alias("expired_tcp"),
    )
    udp_row = udp_sessions(df, th).withColumn("as_of", latest(df)).agg(
        F.struct(
        F.count_if(alive).alias("udp_sessions"),
        F.coalesce(net.round6(F.avg(F.when(alive, F.col("packet_count")))), F.lit(0.0))
        .alias("avg_packets_per_session")))
    return tcp_row.withColumn("udp", udp_row.scalar()).select(
        "tcp_connections", "established", "connecting", "closing", "avg_duration", "udp.udp_sessions",
        "udp.avg_packets_per_session", F.col("expired_tcp").alias("history_size"),
    )


def active_connections(df: DataFrame, th: Thresholds = DEFAULTS, limit: int | None = 100) -> DataFrame:
    """Connections seen within the idle time of the newest packet; TCP first, newest activity first."""
    both = tcp_connections(df, th).drop("flags_seen").unionByName(
        udp_sessions(df, th).withColumn("state", F.lit("ACTIVE"))
    )
    out = both.where(F.col("last_us") >= latest(df) - th.connection_idle_us)
    if limit is None:
        return out
    return out.orderBy(
        "protocol", F.desc("last_us"), "src_ip", "src_port", "dst_ip", "dst_port"
    ).limit(limit)
