"""Sequential scans: the result does not depend on how many tasks a key is spread over."""

import random
from dataclasses import replace

import numpy as np
import pytest
from helpers import S, packet, packets, sequential_admission, sequential_flows

from flowlantern.config import DEFAULTS
from flowlantern.operators import alerts as al, flows as fl
from flowlantern.operators.limits import SlidingLimit
from flowlantern.operators.ordered import Rows


def _flow_pids(spark, rows, th=DEFAULTS):
    got = fl.flow_packets(packets(spark, rows), th).select("pid", "flow_pid").collect()
    return {r.pid: r.flow_pid for r in got}


def _want(rows, **kw):
    return sequential_flows([((r[2], r[3], r[4], r[5], r[6]), r[1], r[0]) for r in rows], **kw)


def _stream(rng, n, gaps):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice(gaps)
        out.append(t)
    return out


@pytest.mark.parametrize("gaps", [
    [1_000, 5_000],                       # dense: only the packet limit closes flows, phases never meet
    [S, 5 * S, 20 * S],                   # the 60 s limit closes flows
    [100, S, 59 * S, 60 * S, 61 * S],     # pauses on both sides of the idle limit
    [0, 0, 1],                            # many equal times
])
def test_hot_key_over_many_partitions(spark, many_partitions, gaps):
    rng = random.Random(7)
    rows = [packet(i, t) for i, t in enumerate(_stream(rng, 9000, gaps))]
    rows += [packet(10_000 + i, t, src=f"10.0.0.{i % 40}", sport=2000 + i % 7) for i, t in enumerate(_stream(rng, 2000, gaps))]
    assert _flow_pids(spark, rows) == _want(rows)


def test_small_limits_and_few_rows_per_partition(spark, many_partitions):
    rng = random.Random(3)
    th = replace(DEFAULTS, flow_max_packets=5, flow_active_us=10 * S, flow_idle_us=4 * S)
    rows = [packet(i, t, sport=1000 + (i % 3 == 0)) for i, t in enumerate(_stream(rng, 400, [S // 2, S, 3 * S, 5 * S]))]
    assert _flow_pids(spark, rows, th) == _want(rows, idle=4 * S, active=10 * S, most=5)


def _parts(ts, rng):
    """Blocks of random size of one key as the rules see them."""
    return [{"ts_us": np.array(t, np.int64), "pid": np.array(p, np.int64)} for t, p in zip(*_cut(ts, rng))]


def _cut(ts, rng):
    bounds = [0, *sorted(rng.sample(range(1, len(ts)), min(len(ts) - 1, rng.randint(2, 9)))), len(ts)]
    return [ts[a:b] for a, b in zip(bounds, bounds[1:])], [list(range(a, b)) for a, b in zip(bounds, bounds[1:])]


def _same(rule, a, b):
    if isinstance(rule, fl.FlowRule):
        names = ["last", "n"] + (["start", "pid"] if b["n"] else [])
        return {k: a[k] for k in names} == {k: b[k] for k in names}
    live = lambda s: [t for t in s["passed"] if t >= s["end"] - rule.window_us]
    return live({**a, "end": b["end"]}) == live(b)


RULES = [
    fl.FlowRule(60 * S, 60 * S, 1000), fl.FlowRule(4 * S, 10 * S, 5), SlidingLimit(10, 60 * S, "k", "f"), SlidingLimit(1, 60 * S - 1, "k", "f"),
    SlidingLimit(3, 2 * S, "k", "f"),
]


@pytest.mark.parametrize("rule", RULES, ids=str)
@pytest.mark.parametrize("gaps", [
    [S // 10], [10_000, 40_000, S], [0, 0, 0, S, 3 * S], [0, 1], [S, 7 * S, 30 * S], [S // 2, S, 3 * S, 5 * S, 61 * S], [1, 1, 1, 1, 40 * S]])
def test_transfer_maps(rule, gaps):
    """The map of a block gives what scanning its rows gives; composed maps give what one after the other gives."""
    rng = random.Random(str(gaps))
    for n in (40, 300, 2500):
        parts = _parts(_stream(rng, n, gaps), rng)
        state, carried, pending = None, None, None
        for k, columns in enumerate(parts):
            new = np.zeros(len(columns["ts_us"]), bool)
            new[0] = state is None
            _, state = rule.step(Rows(new, "a", columns), state)
            state["end"] = int(columns["ts_us"][-1])
            table = rule.transfer(columns)
            if table is None:  # a pause: the end state is that of a scan that begins with the block
                new[0] = True
                _, carried = rule.step(Rows(new, "a", columns), None)
                pending = None
                assert _same(rule, carried, state)
            else:
                before = carried
                carried = rule.apply(table, "a", carried)
                assert _same(rule, carried, state)
                # all blocks since the last pause, merged from the left and in pairs
                both = rule.compose(pending[1], table) if pending else None
                pending = (pending[0], both, [*pending[2], table]) if both else (before, table, [table])
                assert _same(rule, rule.apply(pending[1], "a", pending[0]), state)
                tree = pending[2]
                while len(tree) > 1:
                    tree = [rule.compose(*tree[i:i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
                assert _same(rule, rule.apply(tree[0], "a", pending[0]), state)


@pytest.mark.parametrize("gaps", [[S // 10, S], [6 * S, 7 * S], [S, 59 * S, 60 * S, 60 * S + 1, 61 * S], [0, 1]])
def test_admission_over_many_partitions(spark, many_partitions, gaps):
    rng = random.Random(11)
    rows = []
    for i, t in enumerate(_stream(rng, 3000, gaps)):
        src = "10.0.0.1" if i % 3 else f"10.0.0.{i % 5}"
        rows.append((i, t, src, "dos", rng.choice(["LOW", "HIGH"])))
    df = spark.createDataFrame(rows, "alert_id bigint, ts_us bigint, source_ip string, attack_type string, priority string")
    got = {r.alert_id: (r.rate_limited, r.duplicate) for r in al.admission(df).collect()}
    assert got == sequential_admission([(r[2], r[4], r[1], r[0]) for r in rows])


def _jobs(spark, run):
    """The result of ``run`` and the number of jobs it took."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


@pytest.mark.parametrize("kind", ["flows", "limit"])
def test_one_dense_key_over_64_partitions(spark, many_partitions, kind, monkeypatch):
    """No chain of jobs over the partitions of a key: rounds grow with the logarithm of their number."""
    from flowlantern.operators import ordered

    seen = []
    plain = ordered.start_states
    monkeypatch.setattr(ordered, "start_states", lambda rule, records, parts: plain(rule, seen.append((records, parts)) or records, parts))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    if kind == "flows":
        rows = [packet(i, i * 2000) for i in range(40_000)]
        got, jobs = _jobs(spark, lambda: _flow_pids(spark, rows))
        assert got == _want(rows)
    else:
        df = spark.range(40_000).selectExpr("id AS alert_id", "id * 100000 AS ts_us", "'s' AS source_ip", "'dos' AS attack_type", "'LOW' AS priority")
        got, jobs = _jobs(spark, lambda: {r.alert_id: (r.rate_limited, r.duplicate) for r in al.admission(df, dedup=False).collect()})
        want = sequential_admission([("s", "LOW", i * 100000, i) for i in range(40_000)])
        assert {i for i, r in got.items() if not r[0]} == {i for i, r in want.items() if not r[0]}
    records, parts = seen[0]
    assert parts == 64 and records.where("whole").count() > 50
    assert jobs <= 8, jobs


@pytest.mark.parametrize("fan", [2, 3])
def test_tree_of_maps(spark, many_partitions, monkeypatch, fan):
    """Several levels up and down the tree, with borders of keys in between."""
    from flowlantern.operators import ordered

    monkeypatch.setattr(ordered, "FAN", fan)
    rng = random.Random(fan)
    rows = [packet(i, t, sport=1000 + (i % 9 == 0)) for i, t in enumerate(_stream(rng, 4000, [1000, S // 10, 59 * S]))]
    assert _flow_pids(spark, rows) == _want(rows)
    alerts = [(i, t, "10.0.0.1" if i % 3 else f"10.0.0.{i % 5}", "dos", "LOW") for i, t in enumerate(_stream(rng, 3000, [S // 10, S]))]
    df = spark.createDataFrame(alerts, "alert_id bigint, ts_us bigint, source_ip string, attack_type string, priority string")
    got = {r.alert_id: (r.rate_limited, r.duplicate) for r in al.admission(df).collect()}
    assert got == sequential_admission([(r[2], r[4], r[1], r[0]) for r in alerts])
