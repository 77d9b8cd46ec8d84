"""Packets and plain sequential models of the rules, independent of the package."""

from __future__ import annotations

S = 1_000_000
T0 = 1_704_067_200 * S
PACKET_DDL = (
    "pid bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size int, "
    "payload_size int, flags string, ttl int, http_user_agent string, dns_query string, label int")


def packet(pid, at, src="10.0.0.1", dst="8.8.8.8", sport=1000, dport=80, proto="TCP", size=100, payload=60, flags="A",
           agent=None, dns=None, label=0):
    return (pid, T0 + int(at), src, dst, sport, dport, proto, size, payload, flags, 64, agent, dns, label)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET_DDL)


def sequential_flows(rows, idle=60 * S, active=60 * S, most=1000):
    """{pid: pid of the first packet of its flow} by one pass over (key, ts, pid) rows."""
    out, state = {}, {}
    for key, ts, pid in sorted(rows):
        cur = state.get(key)
        if cur is None or cur["closed"] or ts - cur["last"] > idle:
            cur = {"start": ts, "pid": pid, "n": 0, "closed": False}
        cur["n"] += 1
        cur["last"] = ts
        cur["closed"] = ts - cur["start"] > active or cur["n"] > most
        state[key] = cur
        out[pid] = cur["pid"]
    return out


def sequential_admission(rows, limit=10, frame=60 * S, dedup=60 * S):
    """{id: (rate_limited, duplicate)} over (key, priority, ts, id) rows."""
    out, passed, kept = {}, {}, {}
    for ts, i, key, prio in sorted((r[2], r[3], r[0], r[1]) for r in rows):
        recent = [t for t in passed.get(key, []) if t >= ts - frame]
        if len(recent) >= limit:
            out[i] = (True, False)
            passed[key] = recent
            continue
        passed[key] = recent + [ts]
        last = kept.get((key, prio))
        dup = last is not None and ts - last < dedup
        if not dup:
            kept[(key, prio)] = ts
        out[i] = (False, dup)
    return out
