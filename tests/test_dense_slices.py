"""Behavioural rules on one victim whose packets fill single slices: two-level sums equal a scan."""

import random
from dataclasses import replace

import pytest
from helpers import S, T0, packet, packets

from flowlantern.operators import rules as op


def _scan(times, window, threshold):
    """Times (with repeats) at which at least ``threshold`` packets lie in [t - window, t]."""
    return {t: n for t in times if (n := sum(t - window <= x <= t for x in times)) >= threshold}


@pytest.mark.parametrize("gaps", [[0, 1, 5_000], [1], [9_999, 156_250, 3 * S], [S // 2, 10 * S, 10 * S + 1]])
def test_flood_counts(spark, many_partitions, gaps):
    rng = random.Random(str(gaps))
    t, times = 100 * S, []
    for _ in range(600):
        t += rng.choice(gaps)
        times.append(t)
    df = packets(spark, [packet(i, t, src=f"10.1.{i % 3}.{i % 7}", sport=1000 + i % 50, flags="S") for i, t in enumerate(times)])
    rule = replace(op.default_rule("syn_flood"), threshold=20)
    got = {r.ts_us - T0: r.frame_count for r in op.behavioural_matches(df, [rule]).collect()}
    assert got == _scan(times, op._spec(rule).window_us, 20)


def test_blocks_split_a_slice(spark):
    """All packets in one slice: the running sums are dealt by block, not by slice."""
    rows = [(("r", "k", 0, 10 * S, i * 2_000, 1, 0, 1)) for i in range(5_000)]
    steps = spark.createDataFrame(rows, "rule string, key string, slice bigint, g bigint, at bigint, dn bigint, dd bigint, point int")
    out = op.running_counts(steps)
    assert {r["at"]: r["n"] for r in out.collect()} == {i * 2_000: i + 1 for i in range(5_000)}
    assert op.running_counts(steps.limit(0)).count() == 0
