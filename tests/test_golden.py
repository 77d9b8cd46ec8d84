"""Hand-made cases with known answers."""

from dataclasses import replace

import pytest
from helpers import S, T0, packet, packets
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS
from flowlantern.functions import net
from flowlantern.operators import (
    alerts as al, connections as co, ensemble as en, features as ft, flows as fl, logs as lg, metrics as me, packets as pk,
    quality as qu, rules as ru, windows as win)


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("gap,flows", [(60 * S, 1), (60 * S + 1, 2)])
def test_flow_idle_gap(spark, gap, flows):
    df = packets(spark, [packet(0, 0), packet(1, gap)])
    assert fl.flows(fl.flow_packets(df)).count() == flows


def test_flow_active_limits(spark):
    steady = [packet(i, i * S) for i in range(70)]  # closes on the first packet past 60 s, which it contains
    got = one(fl.flows(fl.flow_packets(packets(spark, steady))).orderBy("start_us"), "packet_count")
    assert got == [(62,), (8,)]
    burst = [packet(i, i * 900) for i in range(1005)]
    got = one(fl.flows(fl.flow_packets(packets(spark, burst))).orderBy("start_us"), "packet_count")
    assert got == [(1001,), (4,)]


def test_single_packet_flow(spark):
    f = fl.flow_features(fl.flow_packets(packets(spark, [packet(0, 0)]))).first()
    assert (f.duration, f.packets_per_second, f.std_inter_arrival_time, f.std_packet_size, f.burstiness, f.regularity) == (0, 0, 0, 0, 0, 1)


def test_inter_arrival_starts_with_zero(spark):
    f = fl.flow_features(fl.flow_packets(packets(spark, [packet(0, 0), packet(1, S), packet(2, 3 * S)]))).first()
    assert (f.avg_inter_arrival_time, f.std_inter_arrival_time) == (1.0, 1.0)


def test_flags(spark):
    df = spark.createDataFrame([(x,) for x in ("", "F", "FPU", "FPUA", "S", "SA", "FA", "RA", "UPF")], "flags string")
    got = {r[0]: (r[1], r[2], r[3]) for r in one(
        df, "flags", net.tcp_scan_type(F.col("flags")), net.tcp_state(F.col("flags")), net.flags_are(F.col("flags"), "FPU"))}
    assert got == {
        "": ("NULL", "UNKNOWN", False), "F": ("FIN", "UNKNOWN", False), "FPU": ("XMAS", "UNKNOWN", True),
        "FPUA": (None, "CLOSED", False), "S": (None, "SYN_SENT", False), "SA": (None, "SYN_RECEIVED", False),
        "FA": (None, "CLOSED", False), "RA": (None, "RESET", False), "UPF": ("XMAS", "UNKNOWN", True)}


def test_addresses(spark):
    ips = ["10.1.2.3", "172.31.255.255", "172.32.0.0", "192.168.0.1", "127.0.0.1", "8.8.8.8", "unknown", "256.1.1.1", None]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = [r[0] for r in one(df, net.is_internal_ip(F.col("ip")))]
    assert got == [True, True, False, True, True, False, False, False, False]
    valid = ["1.2.3.4", "::1", "2001:db8::1", "fe80::", "1:2:3:4:5:6:7:8"]
    bad = ["1.2.3", "01.2.3.4", "1.2.3.4.5", "1::2::3", "xyz", "12345::", ":", "1:2:3:4:5:6:7:8:9", ""]
    df = spark.createDataFrame([(x,) for x in valid + bad], "ip string")
    assert [r[0] for r in one(df, net.is_valid_ip(F.col("ip")))] == [True] * len(valid) + [False] * len(bad)


def test_cidr_pattern_covers_whole_block(spark):
    import ipaddress
    import re

    block = ipaddress.ip_network("10.4.32.0/21")
    pattern = re.compile("^(?:" + net.cidr_pattern(str(block)) + ")$")
    around = range(int(block.network_address) - 600, int(block.broadcast_address) + 600)
    for n in around:
        ip = ipaddress.ip_address(n)
        assert bool(pattern.match(str(ip))) == (ip in block)


def test_protocol_label(spark):
    df = spark.createDataFrame([(4, 6, None), (4, 17, None), (6, 1, None), (4, 99, None), (None, None, 1), (None, None, None)],
                               "v int, p int, a int")
    got = [r[0] for r in one(df, pk.protocol_label(F.col("v"), F.col("p"), F.col("a")))]
    assert got == ["TCP", "UDP", "ICMP", "UNKNOWN", "ARP", "UNKNOWN"]


def test_connections_take_direction_and_state_from_first_and_last(spark):
    rows = [packet(0, 0, flags="S"), packet(1, S, src="8.8.8.8", dst="10.0.0.1", sport=80, dport=1000, flags="SA"),
            packet(2, 2 * S, flags="FA"), packet(3, 302 * S, flags="S"), packet(4, 302 * S + 300 * S + 1, flags="R")]
    got = one(co.tcp_connections(packets(spark, rows)).orderBy("start_us"), "src_ip", "packet_count", "state", "flags_seen")
    assert got == [("10.0.0.1", 4, "SYN_SENT", ["A", "F", "S"]), ("10.0.0.1", 1, "RESET", ["R"])]


def alert_rows(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + int(t), src, dst, kind, prio, 0.5, "manual", "NEW") for i, (t, src, dst, kind, prio) in enumerate(rows)],
        "alert_id bigint, ts_us bigint, source_ip string, target_ip string, attack_type string, priority string, "
        "confidence double, source string, status string")


def test_dedup(spark):
    df = alert_rows(spark, [(t, "a", "b", "dos", "LOW") for t in (0, 60 * S - 1, 60 * S, 120 * S)])
    assert one(al.admission(df).orderBy("alert_id"), "duplicate") == [(False,), (True,), (False,), (False,)]


@pytest.mark.parametrize("last,limited", [(59 * S, True), (60 * S, True), (60 * S + 1, False)])
def test_limiter(spark, last, limited):
    df = alert_rows(spark, [(i * 1000, "a", "b", "dos", "LOW") for i in range(10)] + [(last, "a", "b", "dos", "LOW")])
    assert one(al.admission(df).where("alert_id = 10"), "rate_limited") == [(limited,)]


@pytest.mark.parametrize("target,other,gap,groups", [
    ("b", "b", 240 * S, 1), ("b", "b", 240 * S + 1, 2), ("b", "c", S, 2), (None, None, 90 * S, 1), (None, None, 90 * S + 1, 2),
    (None, "b", S, 2)])
def test_correlation(spark, target, other, gap, groups):
    df = alert_rows(spark, [(0, "a", target, "dos", "LOW"), (gap, "a", other, "dos", "CRITICAL")])
    assert al.correlation_groups(df).count() == groups
    assert al.correlation_members(df).select("correlation_id").distinct().count() == groups


def test_uncorrelated_types_have_no_group(spark):
    df = alert_rows(spark, [(0, "a", "b", "suspicious", "LOW")])
    assert al.correlation_groups(df).count() == 0
    assert one(al.correlation_members(df), "correlation_id") == [(None,)]


def test_votes(spark):
    rows = [(p, f"m{i}", v) for p, vs in enumerate([(1, 0), (1, 1, 0), (0, 0, 0), (1, 1, 1)]) for i, v in enumerate(vs)]
    v = spark.createDataFrame(rows, "pid bigint, model string, vote int")
    assert [r[0] for r in one(en.majority_vote(v).orderBy("pid"), "is_anomaly")] == [False, True, False, True]
    assert one(en.consensus_vote(v).orderBy("pid"), "is_anomaly", "confidence") == [(False, 0.0), (False, 0.0), (False, 1.0), (True, 1.0)]


@pytest.mark.parametrize("first,second,trend", [(10, 13, "increasing"), (10, 7, "decreasing"), (10, 11, "stable")])
def test_trend(spark, first, second, trend):
    rows = [(i, i * 1000, i < first, 0.5, 0.5) for i in range(100)]
    rows += [(100 + i, 600 * S + i * 1000, i < second, 0.5, 0.5) for i in range(100)]
    det = spark.createDataFrame(rows, "pid bigint, ts_us bigint, is_anomaly boolean, confidence double, anomaly_score double")
    assert en.anomaly_trends(det, 1200 * S, as_of=1100 * S).first().trend == trend


def test_window_scores(spark):
    rows = [packet(i, i * 1000, src="9.9.9.9", dst="10.0.0.5", dport=i + 1, flags="S") for i in range(25)]
    df = packets(spark, rows)
    assert one(win.port_scan_scores(df), "max_src_ports", "port_scan_score") == [(25, 0.5)]
    assert one(win.dos_scores(df, replace(DEFAULTS, dos_rate_min=2.0, dos_rate_full=5.0)), "max_rate", "dos_score") == [(2.5, 0.5)]
    assert one(win.unusual_protocol_scores(df), "unusual_protocol_score") == [(0.0,)]


def test_regex_anchor_and_text(spark):
    name = "0123456789abcdef0123456789ABCDEF.evil.example"
    rows = [packet(0, 0, proto="UDP", dport=53, dns=name), packet(1, 1, proto="UDP", dport=53, dns="x" + name),
            packet(2, 2, proto="UDP", dport=54, dns=name), packet(3, 3, dport=443, agent="Mozilla SQLMap/1")]
    m = ru.stateless_matches(packets(spark, rows), ru.DEFAULT_RULES)
    got = one(m.orderBy("pid"), "pid", "signature_id", m["context"]["matched_text"])
    assert got == [(0, "c2_dns_query", name), (3, "suspicious_user_agent", "Mozilla SQLMap/1")]


def test_actions_fold(spark):
    a = alert_rows(spark, [(0, "a", "b", "dos", "LOW"), (1, "a", "b", "dos", "LOW"), (2, "a", "b", "dos", "LOW")])
    log = spark.createDataFrame([(0, "ACKNOWLEDGE", "ann", None, 5), (0, "RESOLVE", "bob", "fixed", 9), (1, "ACKNOWLEDGE", "ann", None, 5),
                                 (1, "ACKNOWLEDGE", "bob", None, 7)], "alert_id bigint, action string, actor string, notes string, at_us bigint")
    got = one(al.apply_actions(a, log).orderBy("alert_id"), "status", "assigned_to", "notes", "resolved_us")
    assert got == [("RESOLVED", "ann", "fixed", 9), ("ACKNOWLEDGED", "bob", None, None), ("NEW", None, None, None)]


def test_scaling_and_merged_statistics(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(10)], "pid bigint, a double, b double")
    z = ft.scale(df, ft.fit_standard(df, ["a", "b"])).orderBy("pid").collect()
    assert z[0].a == pytest.approx(-4.5 / 8.25 ** 0.5) and z[0].b == 0
    m = ft.scale(df, ft.fit_minmax(df, ["a", "b"])).orderBy("pid").collect()
    assert (m[0].a, m[9].a, m[5].b) == (0, 1, 0)
    whole = {r.feature: (r.n, r.mean, r.sd) for r in ft.merge_stats(ft.batch_stats(df, ["a", "b"], F.lit(0))).collect()}
    parts = {r.feature: (r.n, r.mean, r.sd) for r in ft.merge_stats(ft.batch_stats(df, ["a", "b"], F.col("pid") % 3)).collect()}
    for f in whole:
        assert parts[f] == pytest.approx(whole[f])
    online = ft.apply_online(df, ["a", "b"], ft.merge_stats(ft.batch_stats(df, ["a", "b"], F.lit(0)))).orderBy("pid").collect()
    assert online[0].a == pytest.approx(z[0].a)


def test_mutual_information_ranks_informative_feature_first(spark):
    rows = [(i, float(i % 2 * 10 + i % 3), float(i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "pid bigint, good double, noise double, label int")
    s = {r.feature: r.score for r in ft.mutual_information(df, ["good", "noise"]).collect()}
    assert s["good"] == pytest.approx(0.6931, abs=1e-3) and s["noise"] < 0.05
    assert [r.feature for r in ft.top_features(ft.f_scores(df, ["good", "noise"]), 1).collect()] == ["good"]
    assert ft.select_features(df, ft.f_scores(df, ["good", "noise"]), 1).columns == ["pid", "good", "label"]


def test_metrics_on_zero_division(spark):
    p = spark.createDataFrame([(1, 0), (0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = me.weighted_metrics(me.confusion(p)).first()
    assert (m.accuracy, m.precision, m.recall) == (0.5, 0.25, 0.5)


def test_clean_text(spark):
    df = spark.createDataFrame([("<a>'\"\x01b" + "x" * 300,), (None,)], "t string")
    got = [r[0] for r in one(df, qu.clean_text(F.col("t")))]
    assert got == ["ab" + "x" * 253, ""]


def test_log_search_takes_broken_patterns_literally(spark):
    df = spark.createDataFrame([(1, 1, "INFO", "c", "call f(x", "{}", None), (2, 2, "INFO", "c", "call g", "{}", None)],
                               "log_id bigint, ts_us bigint, level string, component string, message string, details string, source_ip string")
    assert one(lg.log_search(df, "F(X"), "log_id") == [(1,)]
