"""Unidirectional flows: segmentation, per-flow features and vectors.

A flow of a directional 5-tuple ends before a pause of more than 60 s, on the packet that makes it longer than
60 s, or on its packet 1001. The last two rules depend on where the flow began, so they are a sequential scan
(:mod:`flowlantern.operators.ordered`); everything after the scan is plain aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net
from flowlantern.operators.ordered import Rows, ordered_scan

@dataclass(frozen=True)
class FlowRule:
    """Splits the sorted packets of a key into flows. State: start, first pid, size and last time of the open flow.

    The transfer map of a block holds, for every row at which the first flow that begins in the block may begin, the flow that is open
    at its end. Any ``max_packets + 1`` consecutive rows hold the begin of a flow, so it has at most ``max_packets + 2`` entries.
    Fields: n (rows), first and last (times), head (times of the rows that may be the first begin); start, pid, left (begin, first
    id and size of the open flow; size 0: none is).
    """

    idle_us: int
    active_us: int
    max_packets: int
    key: str = "flow_key"
    needs: tuple[str, ...] = ("ts_us", "pid")
    adds: str = "flow_pid bigint, iat_us bigint"

    def step(self, rows: Rows, state: dict | None):
        ts, pid, new_key = rows.columns["ts_us"], rows.columns["pid"], rows.new_key
        n = len(ts)
        pause = np.zeros(n, bool)
        pause[1:] = ~new_key[1:] & (np.diff(ts) > self.idle_us)
        if not new_key[0]:
            pause[0] = ts[0] - state["last"] > self.idle_us
        cut = new_key | pause
        carried = not cut[0] and state["n"] > 0
        begin = np.flatnonzero(np.concatenate(([True], cut[1:])))
        end = np.append(begin[1:], n)
        first = np.repeat(begin, end - begin)  # index of the first row of the flow, -1 for the carried-in one
        long = (end - begin > self.max_packets) | (ts[end - 1] - ts[begin] > self.active_us)
        long[0] |= carried
        open_n = 0
        for s in np.flatnonzero(long):
            a, b = begin[s], end[s]
            at, start, had = a, ts[a], 0
            mark = a
            if s == 0 and carried:
                start, had, mark = state["start"], state["n"], -1
            while at < b:
                over = at + int(np.searchsorted(ts[at:b], start + self.active_us, side="right"))
                last = min(over, at + self.max_packets - had)  # row that closes the flow
                first[at:min(last + 1, b)] = mark
                open_n = had + b - at if last >= b else 0
                at, had = last + 1, 0
                if at < b:
                    mark, start = at, ts[at]
        flow_pid = np.where(first >= 0, pid[first], state["pid"] if carried else 0)
        iat = np.zeros(n, np.int64)
        iat[1:] = np.where((first[1:] == first[:-1]) & ~cut[1:], np.diff(ts), 0)
        if carried:
            iat[0] = ts[0] - state["last"]
        if not long[-1]:
            open_n = int(end[-1] - begin[-1])
        lead = first[-1]
        after = {
            "key": rows.last_key, "last": int(ts[-1]), "n": int(open_n), "pid": int(flow_pid[-1]),
            "start": int(ts[lead]) if lead >= 0 else state["start"],
        }
        return {"flow_pid": flow_pid, "iat_us": iat}, after

    def transfer(self, columns: dict[str, np.ndarray]) -> dict | None:
        ts, pid = columns["ts_us"], columns["pid"]
        n = len(ts)
        if (np.diff(ts) > self.idle_us).any():
            return None  # a flow begins after the pause, whatever came before
        head = min(n, self.max_packets + 2)
        close = np.minimum(np.searchsorted(ts, ts + self.active_us, side="right"), np.arange(n) + self.max_packets)
        at = np.arange(head)
        moving = close[at] + 1 < n
        while moving.any():
            at[moving] = close[at[moving]] + 1
            moving = close[at] + 1 < n
        is_open = close[at] >= n
        return {"n": n, "first": int(ts[0]), "last": int(ts[-1]), "head": ts[:head],
                "start": ts[at], "pid": pid[at], "left": np.where(is_open, n - at, 0)}

    def _applied(self, m: dict, start, pid, left, last: int):
        """End (start, pid, left) for open flows given as arrays; ``left`` 0 means that none is open."""
        start, pid, left = (np.array(x, np.int64) for x in (start, pid, left))
        carried = (left > 0) & (m["first"] - last <= self.idle_us)
        over = np.searchsorted(m["head"], start + self.active_us, side="right")
        over = np.where((over == len(m["head"])) & (over < m["n"]), m["n"], over)
        row = np.where(carried, np.minimum(over, self.max_packets - left), -1)  # the one that closes the flow
        entry = row + 1
        through, none = row >= m["n"], entry == m["n"]  # the flow stays open; it closes on the last row
        e = np.minimum(entry, len(m["head"]) - 1)
        return (np.where(through, start, m["start"][e]), np.where(through, pid, m["pid"][e]),
                np.where(through, left + m["n"], np.where(none, 0, m["left"][e])))

    def apply(self, table: dict, key, state: dict | None) -> dict:
        s = state or {"start": 0, "pid": 0, "n": 0, "last": 0}
        start, pid, left = self._applied(table, [s["start"]], [s["pid"]], [s["n"]], s["last"])
        return {"key": key, "last": table["last"], "n": int(left[0]), "pid": int(pid[0]), "start": int(start[0])}

    def compose(self, first: dict, second: dict) -> dict | None:
        if second["first"] - first["last"] > self.idle_us:
            return None
        ends = self._applied(second, first["start"], first["pid"], first["left"], first["last"])
        n = first["n"] + second["n"]
        more = max(0, min(self.max_packets + 2, n) - len(first["head"]))  # the head reaches into the second block
        names = ("head", "start", "pid", "left")
        return {"n": n, "first": first["first"], "last": second["last"],
                **{c: np.concatenate((x, second[c][:more])) for c, x in zip(names, (first["head"], *ends))}}


def flow_packets(df: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Packets with ``flow_pid`` (id of the first packet of their flow) and ``iat_us`` (0 for that packet)."""
    rows = df.select(
        "pid", "ts_us", net.flow_key().alias("flow_key"),
        "src_ip", "dst_ip", *[net.port_or_zero(F.col(c)).alias(c) for c in ("src_port", "dst_port")],
        "protocol", "packet_size", "flags",
        F.col("label") if "label" in df.columns else F.lit(0).alias("label"),
    )
    rule = FlowRule(th.flow_idle_us, th.flow_active_us, th.flow_max_packets)
    return ordered_scan(rows, rule, ["ts_us", "pid"])


def flows(marked: DataFrame) -> DataFrame:
    """One row per flow: key, bounds, size. ``marked`` is the output of :func:`flow_packets`."""
    return marked.groupBy("flow_pid", "flow_key").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count("*").alias("packet_count"), F.sum("packet_size").alias("byte_count"),
    )


FLAGS = "SAFRPU"


def flow_features(marked: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """All features of a flow. A flow holds at most 1001 packets, so no group is large."""
    sec = F.lit(float(SECOND))
    tcp = F.upper("protocol") == "TCP"
    fwd, size = net.is_forward(), F.col("packet_size")
    # grouped by what is the same for all packets of a flow: strings as keys leave a hash aggregate, as values they don't
    g = marked.groupBy("flow_pid", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count("*").alias("packet_count"), F.sum("packet_size").alias("byte_count"),
        F.coalesce(F.stddev_samp(F.col("iat_us") / sec), F.lit(0.0)).alias("iat_sd"),
        F.coalesce(F.stddev_samp("packet_size"), F.lit(0.0)).alias("size_sd"),
        F.min("packet_size").alias("min_packet_size"), F.max("packet_size").alias("max_packet_size"),
        F.count_if(fwd).alias("src_to_dst_packets"), F.count_if(~fwd).alias("dst_to_src_packets"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("src_to_dst_bytes"),
        F.sum(F.when(~fwd, size).otherwise(0)).alias("dst_to_src_bytes"),
        *[F.count_if(tcp & net.has_flag(F.col("flags"), x)).alias(f"tcp_flag_{x}") for x in FLAGS],
        F.max("label").alias("label"),
    )
    return derived_features(g, th)


def derived_features(g: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """The features that follow from the aggregates of a flow; shared with the streaming form."""
    n, dur = F.col("packet_count"), (F.col("end_us") - F.col("start_us")) / F.lit(float(SECOND))
    iat_mean = dur / n  # the list of gaps starts with a 0 for the first packet
    burst = net.ratio(F.col("iat_sd"), iat_mean)
    return g.select(
        "flow_pid", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "end_us",
        "packet_count", "byte_count", dur.alias("duration"),
        net.ratio(n, dur).alias("packets_per_second"), net.ratio(F.col("byte_count"), dur).alias("bytes_per_second"),
        iat_mean.alias("avg_inter_arrival_time"), F.col("iat_sd").alias("std_inter_arrival_time"),
        (F.col("byte_count") / n).alias("avg_packet_size"), F.col("size_sd").alias("std_packet_size"),
        "min_packet_size", "max_packet_size",
        "src_to_dst_packets", "dst_to_src_packets", "src_to_dst_bytes", "dst_to_src_bytes",
        net.is_internal_ip(F.col("src_ip"), th.internal_cidrs).alias("is_internal_src"),
        net.is_internal_ip(F.col("dst_ip"), th.internal_cidrs).alias("is_internal_dst"),
        (net.is_well_known_port(F.col("src_port")) | net.is_well_known_port(F.col("dst_port")))
        .alias("is_well_known_port"),
        F.lit(0.0).alias("port_scan_indicator"),  # kept for vector parity; see the README
        (F.col("tcp_flag_S") / n).alias("syn_flood_ratio"),
        burst.alias("burstiness"), (1.0 / (1.0 + burst)).alias("regularity"),
        *[f"tcp_flag_{x}" for x in FLAGS], "label",
    )


def flag_map(features: DataFrame) -> DataFrame:
    """The flag counts as a map, without the flags that never occur."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(x).alias("key"), F.col(f"tcp_flag_{x}").alias("value")) for x in FLAGS]),
        lambda e: e["value"] > 0,
    )
    return features.withColumn("tcp_flags_count", F.map_from_entries(entries))


def flow_direction(df: DataFrame) -> DataFrame:
    """Packets and bytes by direction of the sorted end points."""
    fwd = net.is_forward()
    lo, hi = net.connection_key()
    return df.groupBy(lo["ip"].alias("low_ip"), hi["ip"].alias("high_ip")).agg(
        F.count_if(fwd).alias("forward_packets"), F.count_if(~fwd).alias("reverse_packets"),
        F.sum(F.when(fwd, F.col("packet_size")).otherwise(0)).alias("forward_bytes"),
        F.sum(F.when(~fwd, F.col("packet_size")).otherwise(0)).alias("reverse_bytes"),
    )


VECTOR = [
    "packet_count", "byte_count", "duration", "packets_per_second", "bytes_per_second", "avg_inter_arrival_time",
    "std_inter_arrival_time", "avg_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
    "src_to_dst_packets", "dst_to_src_packets", "src_to_dst_bytes", "dst_to_src_bytes", "is_internal_src",
    "is_internal_dst", "is_well_known_port", "port_scan_indicator", "syn_flood_ratio", "burstiness", "regularity",
]
PROTOCOLS = ("TCP", "UDP", "ICMP")


def flow_vector(features: DataFrame) -> DataFrame:
    """The 31 doubles of a flow, as columns in their fixed order."""
    return features.select(
        "flow_pid", *[F.col(c).cast("double").alias(c) for c in VECTOR],
        *[F.col(f"tcp_flag_{x}").cast("double").alias(f"tcp_flag_{x}") for x in FLAGS],
        *[(F.col("protocol") == p).cast("double").alias(f"protocol_{p}") for p in PROTOCOLS],
    )
