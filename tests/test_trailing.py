"""Behavioural rules: slices and running sums against counting every frame by hand."""

import random

import pytest
from helpers import S, T0, packet, packets

from flowlantern.operators import rules as ru


def _brute(rows, rule_id, w, threshold):
    tracked = {
        "port_scan_basic": lambda r: bool(r[5]), "syn_flood": lambda r: r[6] == "TCP" and "S" in r[9] and "A" not in r[9],
        "dns_amplification": lambda r: r[6] == "UDP" and r[5] == 53, "ssh_brute_force": lambda r: r[6] == "TCP" and r[5] == 22,
    }[rule_id]
    key = {"port_scan_basic": lambda r: (r[2], r[3]), "syn_flood": lambda r: r[3], "dns_amplification": lambda r: r[2],
           "ssh_brute_force": lambda r: (r[3], r[5])}[rule_id]
    value = {"port_scan_basic": lambda r: r[5], "syn_flood": lambda r: r[2], "dns_amplification": lambda r: r[3],
             "ssh_brute_force": lambda r: None}[rule_id]
    by_key = {}
    for r in rows:
        by_key.setdefault(key(r), []).append(r)
    out = {}
    for group in by_key.values():
        for r in group:
            if rule_id == "ssh_brute_force" and not tracked(r):
                continue
            frame = [x for x in group if tracked(x) and r[1] - w <= x[1] <= r[1]]
            d = len({value(x) for x in frame} - {None})
            if (d if rule_id == "port_scan_basic" else len(frame)) >= threshold:
                out[r[0]] = (len(frame), d)
    return out


def _run(spark, rows, rule_id, **changes):
    m = ru.behavioural_matches(packets(spark, rows), [ru.default_rule(rule_id, **changes)])
    return {r.pid: (r.frame_count, r.frame_distinct) for r in m.collect()}


@pytest.mark.parametrize("rule_id,w,threshold", [
    ("port_scan_basic", 60, 4), ("syn_flood", 10, 5), ("dns_amplification", 60, 6), ("ssh_brute_force", 300, 3), ("syn_flood", 7, 4)])
def test_random_frames(spark, rule_id, w, threshold):
    rng = random.Random(w)
    rows, t = [], 0
    for i in range(700):
        t += rng.choice([0, 1, 200_000, S, 5 * S, 10 * S, 40 * S])
        flags = rng.choice(["S", "SA", "", "A"])
        proto = rng.choice(["TCP", "TCP", "UDP", "ICMP"])
        port = None if proto == "ICMP" else rng.choice([22, 53, 80, 0, *range(100, 106)])
        rows.append(packet(i, t, src=f"198.51.100.{rng.randrange(3)}", dst=f"10.0.0.{rng.randrange(2)}", dport=port, proto=proto, flags=flags))
    conditions = dict(ru.default_rule(rule_id).conditions)
    if rule_id == "port_scan_basic":
        conditions["min_unique_ports"] = threshold
    got = _run(spark, rows, rule_id, time_window=w, threshold=threshold, conditions=conditions)
    assert got == _brute(rows, rule_id, w * S, threshold)


@pytest.mark.parametrize("last,fires", [(10 * S, True), (10 * S + 1, False)])
@pytest.mark.parametrize("start", [0, 3_333_333, 9_999_999])
def test_frame_edge(spark, last, fires, start):
    rows = [packet(i, start + (last if i == 99 else i * 1000), flags="S", dst="10.0.0.80", src=f"1.2.3.{i}") for i in range(100)]
    assert _run(spark, rows, "syn_flood") == ({99: (100, 100)} if fires else {})


def test_rules_keep_their_own_conditions(spark):
    """A rule counts only its own protocol and port, and is evaluated on every packet of its key."""
    rows = [packet(i, i * S, dst="10.0.0.22", dport=22, flags="S") for i in range(4)]
    rows += [packet(10 + i, i * S, dst="10.0.0.22", dport=3389, flags="S") for i in range(5)]
    rows += [packet(20 + i, i * S, dst="10.0.0.22", dport=22, proto="UDP") for i in range(9)]
    m = ru.behavioural_matches(packets(spark, rows), [ru.default_rule("ssh_brute_force"), ru.default_rule("rdp_brute_force")])
    assert [(r.pid, r.signature_id, r.confidence) for r in m.collect()] == [(14, "rdp_brute_force", 0.5)]


def test_same_target_off_joins_all_targets(spark):
    rows = [packet(i, i * 1000, dst=f"10.0.0.{i}", dport=100 + i) for i in range(12)]
    rule = {"conditions": {"min_unique_ports": 10, "same_target": False}}
    assert _run(spark, rows, "port_scan_basic") == {}
    assert _run(spark, rows, "port_scan_basic", **rule) == {9: (10, 10), 10: (11, 11), 11: (12, 12)}


def test_text_and_context(spark):
    rows = [packet(i, i * 1000, flags="S", src="9.9.9.9", dst="10.0.0.80") for i in range(100)]
    m = ru.behavioural_matches(packets(spark, rows), [ru.default_rule("syn_flood")]).collect()
    assert [r.matched_pattern for r in m] == ["SYN flood: 100 SYN packets in 10.0s"]
    assert m[0].context == {"syn_packets": "100", "unique_sources": "1", "time_window": "10.0"}
    assert m[0].ts_us == T0 + 99_000
