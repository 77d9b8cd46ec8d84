"""Traffic windows over a stream. Late rows are dropped by the watermark; rows come out when a window is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net
from flowlantern.operators import windows as win


def _windowed(stream: DataFrame, delay: str, th: Thresholds):
    return stream.withWatermark("ts", delay), F.window("ts", f"{th.window_us // SECOND} seconds")


def _start() -> list:
    return [F.unix_micros(F.col("window.start")).alias("window_us")]


def streaming_windows(stream: DataFrame, closed: DataFrame | None = None, delay: str = "30 seconds",
                      flow_delay: str = "150 seconds", th: Thresholds = DEFAULTS) -> DataFrame:
    """Every aggregate, pattern, ratio and score of a window, all counts exact: the columns of ``windows.window_features``.

    Four chained aggregations, as in the batch form: conversations, then the ports of a source, then sources, targets and
    ports, then the window. State is a few numbers per open conversation and entity, spread over all tasks, and is
    dropped when the watermark passes the window.

    ``closed`` is a stream of closed flows with event time ``ts`` at their end (``start_us``, ``end_us``, addresses, ports, protocol).
    They travel beside the packets of the window they end in. An idle flow is known a minute after its end, so its stream has its own
    delay, ``flow_delay``; a window comes out when both watermarks have passed it. Without it, ``avg_flow_duration`` is 0.
    """
    columns = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "flags"]
    rows, w = _windowed(stream.select(*columns), delay, th)
    rows = rows.withColumn("flow_us", F.lit(None).cast("bigint"))
    if closed is not None:
        ends = closed.withWatermark("ts", flow_delay).select(
            "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.lit(None).cast("int").alias("packet_size"),
            F.lit(None).cast("string").alias("flags"), (F.col("end_us") - F.col("start_us")).alias("flow_us"))
        rows = rows.unionByName(ends)
    is_flow = F.col("flow_us").isNotNull()
    conv = win.conversations(rows, th, w, F.count_if(is_flow).alias("ended"), F.sum("flow_us").alias("flow_us"))
    conv = conv.withColumn("n", F.col("n") - F.col("ended"))
    m = win.measures(conv, th, "window", ("ended", "flow_us"))
    m = m.select(F.unix_micros(F.col("window.start")).alias("window_us"), "*").withColumn(
        "avg_flow_duration", F.col("flow_us") / F.col("ended") / SECOND)
    return win.feature_row(m, th)


def streaming_dos_scores(stream: DataFrame, delay: str = "30 seconds", th: Thresholds = DEFAULTS) -> DataFrame:
    """Two chained aggregations: packets per (window, target), then the largest per window."""
    s, w = _windowed(stream, delay, th)
    g = s.groupBy(w, "dst_ip").agg(F.count("*").alias("n")).groupBy("window").agg(F.max("n").alias("n"))
    rate = F.col("n") / (th.window_us / SECOND)
    return g.select(*_start(), rate.alias("max_rate"), win.dos_score(rate, th).alias("dos_score"))


def streaming_scan_scores(stream: DataFrame, delay: str = "30 seconds", th: Thresholds = DEFAULTS) -> DataFrame:
    """Distinct ports per (window, source) exactly, by aggregating on the port first."""
    s, w = _windowed(stream, delay, th)
    src_in, dst_in = (net.is_internal_ip(F.col(c), th.internal_cidrs) for c in ("src_ip", "dst_ip"))
    g = s.where(src_in != dst_in).groupBy(w, "src_ip", net.port_or_zero(F.col("dst_port")).alias("port")).agg(F.count("*").alias("n"))
    g = g.groupBy("window", "src_ip").agg(F.count("*").alias("ports")).groupBy("window").agg(F.max("ports").alias("ports"))
    return g.select(*_start(), F.col("ports").alias("max_src_ports"), win.scan_score(F.col("ports"), th).alias("port_scan_score"))
