"""Flows over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions import net
from flowlantern.operators.flows import FLAGS, derived_features


def idle_flows(stream: DataFrame, delay: str = "30 seconds", th: Thresholds = DEFAULTS) -> DataFrame:
    """Flows by the idle rule alone, with built-in session windows (merged before the shuffle).

    A flow splits on a pause of more than 60 s; a session window already closes at its gap, so the gap is 1 us longer.
    """
    gap = f"{th.flow_idle_us + 1} microseconds"
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), net.flow_key().alias("flow_key"))
    return g.agg(
        F.count("*").alias("packet_count"), F.sum("packet_size").alias("byte_count"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
    ).select("flow_key", "start_us", "end_us", "packet_count", "byte_count")


_KEY = ["flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_KEY_DDL = "flow_key string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string"
_FLOW_DDL = (
    "flow_pid bigint, start_us bigint, end_us bigint, packet_count bigint, byte_count bigint, iat_sq double, size_sq double, "
    "min_packet_size int, max_packet_size int, flag_counts array<bigint>, label int"
)
_OUT = f"{_KEY_DDL}, {_FLOW_DDL}"
_NAMES = [c.split(" ")[0] for c in _OUT.split(", ")]
# the open flows of a bucket, one array per column; due_ms is the time a flow's timer goes off
_STATE = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split(" ") for c in f"{_OUT}, due_ms bigint".split(", ")))


def full_flows(stream: DataFrame, delay: str = "30 seconds", th: Thresholds = DEFAULTS, buckets: int = 256) -> DataFrame:
    """Flows by the full rule (idle, 60 s, 1001 packets), with all batch features. A flow comes out on the packet that
    closes it, or once the watermark is past its idle time. State per open flow is a few numbers; the sums of squares
    give the deviations.

    Rows of one micro-batch are put in time order per key; a row that arrives late in a later batch joins the open
    flow without moving its end back.

    The open flows of a hash bucket of keys are one state entry. Most keys have a packet or two, so a group per key would cost a call of
    Python for nearly every packet; ``buckets`` bounds the calls of a batch, whatever the number of keys.
    """
    idle, active, most = th.flow_idle_us, th.flow_active_us, th.flow_max_packets
    width = len(_KEY)

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], state.getCurrentWatermarkMs()
        flows = {tuple(r[:width]): [list(r[width:-1]), r[-1]] for r in zip(*state.get)} if state.exists else {}
        touched, rows = {}, []
        for p in () if state.hasTimedOut else batches:
            keys = zip(*[p[c].astype(object).where(p[c].notna(), None).tolist() for c in _KEY])
            rows += zip(p["ts_us"].tolist(), p["pid"].tolist(), p["packet_size"].tolist(), p["flags"].tolist(), p["label"].tolist(), keys)
        rows.sort(key=lambda r: r[:5])
        for t, pid, size, flags, label, key in rows:
            cur = touched[key] if key in touched else flows.get(key, (None,))[0]
            if cur is not None and t - cur[2] > idle:
                out.append((*key, *cur))
                cur = None
            if cur is None:
                cur = [pid, t, t, 0, 0, 0.0, 0.0, size, size, [0] * len(FLAGS), 0]
            gap = max(t - cur[2], 0) / 1e6
            cur[2] = max(t, cur[2])
            cur[3] += 1
            cur[4] += size
            cur[5] += gap * gap
            cur[6] += float(size) * size
            cur[7], cur[8] = min(cur[7], size), max(cur[8], size)
            if key[5] == "TCP":
                cur[9] = [n + (x in flags) for n, x in zip(cur[9], FLAGS)]
            cur[10] = max(cur[10], label)
            if cur[2] - cur[1] > active or cur[3] > most:
                out.append((*key, *cur))
                cur = None
            touched[key] = cur
        # a flow that got rows in this batch has its timer set anew; of the others those come out whose time is over
        held = [(*key, *cur, due) for key, (cur, due) in flows.items() if key not in touched and due >= now]
        out += [(*key, *cur) for key, (cur, due) in flows.items() if key not in touched and due < now]
        held += [(*key, *cur, max(cur[2] // 1000 + idle // 1000 + 1, now + 1)) for key, cur in touched.items() if cur is not None]
        if held:
            state.update(tuple(map(list, zip(*held))))
            state.setTimeoutTimestamp(max(min(r[-1] for r in held), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    rows = stream.withWatermark("ts", delay).select(
        "ts", "ts_us", "pid", "packet_size", "flags", F.col("label") if "label" in stream.columns else F.lit(0).alias("label"),
        net.flow_key().alias("flow_key"), "src_ip", "dst_ip",
        *[net.port_or_zero(F.col(c)).alias(c) for c in ("src_port", "dst_port")], F.upper("protocol").alias("protocol"))
    raw = rows.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    n, dur = F.col("packet_count"), (F.col("end_us") - F.col("start_us")) / SECOND
    sd = lambda sq, total: F.when(n > 1, F.sqrt(F.greatest((sq - total * total / n) / (n - 1), F.lit(0.0)))).otherwise(0.0)
    fwd, zero = net.is_forward(), F.lit(0).cast("bigint")
    return derived_features(raw.withColumns({
        "iat_sd": sd(F.col("iat_sq"), dur), "size_sd": sd(F.col("size_sq"), F.col("byte_count")),
        **{f"src_to_dst_{u}": F.when(fwd, F.col(c)).otherwise(zero) for u, c in (("packets", "packet_count"), ("bytes", "byte_count"))},
        **{f"dst_to_src_{u}": F.when(fwd, zero).otherwise(F.col(c)) for u, c in (("packets", "packet_count"), ("bytes", "byte_count"))},
        **{f"tcp_flag_{x}": F.col("flag_counts")[i] for i, x in enumerate(FLAGS)},
    }), th)
