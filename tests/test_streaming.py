"""Streams: restart from a checkpoint, late rows, retries."""

import time

import numpy as np
import pytest
from helpers import S, T0, packet, packets, sequential_flows

from flowlantern.operators import notify as no, rules as ru, windows as win
from flowlantern.session import scratch_path
from flowlantern.sources import readers
from flowlantern.streaming import alerts as sa, flows as sf, rules as sr, windows as sw
from flowlantern.streaming.rules import frame_counts


def _run(spark, stream, out, ckpt):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_restart_continues_open_flows(spark):
    """A flow open when the job stops goes on after the restart; the result is that of one run."""
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    write = lambda rows: packets(spark, rows).coalesce(1).write.mode("append").parquet(feed)
    make = lambda: sf.full_flows(readers.stream_packets(spark, feed, files_per_trigger=1))
    write([packet(i, i * S) for i in range(20)])
    _run(spark, make(), out, ckpt)
    write([packet(20 + i, (20 + i) * S) for i in range(50)])
    write([packet(99, 10_000 * S, src="10.9.9.9")])
    got = _run(spark, make(), out, ckpt).where("src_ip <> '10.9.9.9'").orderBy("start_us")
    assert [(r.flow_pid, r.packet_count) for r in got.collect()] == [(0, 62), (62, 8)]


def test_late_rows_are_dropped_by_the_watermark(spark):
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    write = lambda rows: packets(spark, rows).coalesce(1).write.mode("append").parquet(feed)
    write([packet(0, 0), packet(1, S)])
    write([packet(2, 200 * S)])
    write([packet(6, 201 * S)])  # lateness is judged by the watermark of the batch before
    write([packet(3, 2 * S), packet(4, 190 * S)])  # the first is too late, the second within the delay
    write([packet(5, 9000 * S)])
    stream = readers.stream_packets(spark, feed, files_per_trigger=1)
    got = _run(spark, sw.streaming_windows(stream, delay="30 seconds"), out, ckpt).orderBy("window_us").collect()
    assert [r.total_packets for r in got] == [2, 1, 2]


def test_scan_scores_match_batch(spark):
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    rows = [packet(i, i * 300_000, src=f"9.9.9.{i % 2}", dst="10.0.0.5", dport=1 + i * 7 % 60) for i in range(120)]
    packets(spark, rows).coalesce(1).write.parquet(feed)
    packets(spark, [packet(999, 9000 * S, src="9.9.9.9", dst="10.0.0.5")]).coalesce(1).write.mode("append").parquet(feed)
    got = _run(spark, sw.streaming_scan_scores(readers.stream_packets(spark, feed)), out, ckpt)
    want = win.port_scan_scores(packets(spark, rows))
    last = want.agg({"window_us": "max"}).first()[0]
    pick = lambda df: sorted((r.window_us, r.max_src_ports, r.port_scan_score) for r in df.where(f"window_us <= {last}").collect())
    assert pick(got) == pick(want)


def test_frame_counts_equal_a_plain_count():
    rng = np.random.default_rng(4)
    w, seen = 50, {}
    for k, v, t in zip(rng.integers(0, 3, 400), rng.integers(-1, 6, 400), rng.integers(0, 600, 400)):
        seen[int(k), int(v), int(t)] = seen.get((int(k), int(v), int(t)), 0) + 1
    rows = sorted(seen)
    cols = [np.array(c, np.int64) for c in zip(*[(*r, seen[r]) for r in rows])]
    q = [(int(k), int(t)) for k, t in zip(rng.integers(0, 4, 300), rng.integers(0, 700, 300))]
    frame, d = frame_counts(*cols, np.array([k for k, _ in q]), np.array([t for _, t in q]), w)
    for (k, t), a, b in zip(q, frame, d):
        near = [r for r in rows if r[0] == k and t - w <= r[2] <= t]
        assert (a, b) == (sum(seen[r] for r in near), len({r[1] for r in near if r[1] >= 0}))


def test_many_spoofed_sources_take_linear_time():
    n = 200_000
    at, code = np.arange(n, dtype=np.int64) * 100, np.arange(n, dtype=np.int64)
    begin = time.perf_counter()
    frame, d = frame_counts(np.zeros(n, np.int64), code, at, np.ones(n, np.int64), np.zeros(n, np.int64), at, 10 * S)
    assert time.perf_counter() - begin < 5 and frame[-1] == d[-1] == 100_001  # both ends of the frame count


def test_late_packets_see_their_own_frame(spark):
    """A value that was seen again later still counts for a late packet whose frame holds its first sighting."""
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    write = lambda rows: packets(spark, rows).coalesce(1).write.mode("append").parquet(feed)
    write([packet(i, i * S, src="9.9.9.9", dst="10.0.0.5", dport=1 + i) for i in range(9)])
    write([packet(20 + i, (25 + i) * S, src="9.9.9.9", dst="10.0.0.5", dport=1 + i) for i in range(9)])
    write([packet(50, 15 * S, src="9.9.9.9", dst="10.0.0.5", dport=90)])  # late, within the delay
    stream = readers.stream_packets(spark, feed, files_per_trigger=1)
    got = _run(spark, sr.behavioural(stream, [ru.default_rule("port_scan_basic")], buckets=1), out, ckpt).collect()
    assert [(r.pid, r.frame_count, r.frame_distinct) for r in got] == [(50, 10, 10)]


def test_windows_hold_the_flows_that_end_in_them(spark):
    feed, flows, out, ckpt = (scratch_path(spark, n) for n in ("feed", "flows", "out", "ckpt"))
    rows = [packet(i, i * S, src=f"9.9.9.{i % 3}", dst="10.0.0.5", dport=80 + i % 4) for i in range(40)]
    packets(spark, rows).coalesce(1).write.parquet(feed)
    packets(spark, [packet(99, 9000 * S)]).coalesce(1).write.mode("append").parquet(feed)
    ddl = "ts_us bigint, start_us bigint, end_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string"
    ends = [(T0 + e * S, T0 + b * S, T0 + e * S, "9.9.9.1", "10.0.0.5", 1000, 80, "TCP") for b, e in ((0, 4), (1, 3), (2, 15), (0, 9000))]
    spark.createDataFrame(ends, ddl).coalesce(1).write.parquet(flows)
    got = _run(spark, sw.streaming_windows(readers.stream_packets(spark, feed), readers.stream_packets(spark, flows, schema=ddl)), out, ckpt)
    got = {(r.window_us - T0) // S: r for r in got.collect()}
    assert [got[w].avg_flow_duration for w in (0, 10, 20, 30)] == [3.0, 13.0, 0.0, 0.0]
    assert all((r.total_packets, r.unique_sources, r.unique_destinations, r.unique_ports) == (10, 3, 1, 5) for r in got.values())


@pytest.mark.parametrize("failures,success,retries", [(0, True, 0), (2, True, 2), (9, False, 2)])
def test_delivery_retries(spark, failures, success, retries):
    df = spark.createDataFrame([(1, 0, "HIGH", "NEW", "a", "b", "dos", 0.5, "manual")],
                               "alert_id bigint, ts_us bigint, priority string, status string, source_ip string, target_ip string, "
                               "attack_type string, confidence double, source string")
    left = {"n": failures}

    def send(alert_id, channel, message):
        if left["n"] > 0:
            left["n"] -= 1
            raise RuntimeError("down")

    r = sa.deliver(no.fan_out(df, [no.Channel("console")]), send).collect()
    assert [(x.success, x.retry_count, x.error) for x in r] == [(success, retries, None if success else "down")]


def test_flows_of_many_keys_share_buckets(spark):
    """The open flows of all keys of a bucket are one state; the result is that of one pass over each key."""
    rows, keys = [], 40
    for i in range(1200):
        k = i * 7 % keys
        rows.append(packet(i, i * S // 4 + (70 * S if i > 600 and k % 3 == 0 else 0), src=f"10.0.0.{k}", sport=None if k % 5 == 0 else k,
                           proto="ICMP" if k % 5 == 0 else "TCP", size=100 + i % 9))
    rows = sorted(rows, key=lambda r: r[1])
    want = {}
    for pid, first in sequential_flows([(r[2], r[1], r[0]) for r in rows]).items():
        want.setdefault(first, []).append(pid)
    seen = []
    for buckets in (1, 5):
        feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
        for at in range(0, len(rows), 400):
            packets(spark, rows[at:at + 400]).coalesce(1).write.mode("append").parquet(feed)
        packets(spark, [packet(9999, 90_000 * S, src="10.9.9.9")]).coalesce(1).write.mode("append").parquet(feed)
        stream = sf.full_flows(readers.stream_packets(spark, feed, files_per_trigger=1), buckets=buckets)
        got = _run(spark, stream, out, ckpt).where("src_ip <> '10.9.9.9'").collect()
        assert {r.flow_pid: r.packet_count for r in got} == {first: len(pids) for first, pids in want.items()} and len(got) == len(want)
        seen.append(sorted(map(str, got)))
    assert seen[0] == seen[1]
