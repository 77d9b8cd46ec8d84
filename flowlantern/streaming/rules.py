"""Detection rules over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlantern.operators import rules as ru

stateless = ru.stateless_matches  # a plain projection: the batch operator serves streams as it is

_OUT = "pid bigint, ts_us bigint, src_ip string, dst_ip string, rule string, n bigint, d bigint"
_STATE = "key array<string>, value array<string>, at array<bigint>, n array<bigint>"


def frame_counts(key: np.ndarray, value: np.ndarray, at: np.ndarray, n: np.ndarray, q_key: np.ndarray, q_at: np.ndarray,
                 w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point (key, time): packets and distinct values of its key in the ``w`` microseconds up to it, ends included.

    Sightings come as codes, ordered by (key, value, time) and not repeated; a negative value is none. A value counts from each
    sighting until ``w`` after it or until its next one, so the distinct number moves by one at either end and is the starts
    less the ends so far: sorting and binary search, whatever the number of values.
    """
    if not len(at):
        return np.zeros(len(q_at), np.int64), np.zeros(len(q_at), np.int64)
    origin = min(at.min(), q_at.min() if len(q_at) else at.min()) - w - 1
    span = max(at.max(), q_at.max() if len(q_at) else at.max()) - origin + w + 2  # keys lie this far apart on one axis
    place = key * span + (at - origin)
    point = q_key * span + (q_at - origin)
    order = np.argsort(place, kind="stable")
    running = np.concatenate(([0], np.cumsum(n[order])))
    sorted_place = place[order]
    frame = running[np.searchsorted(sorted_place, point, side="right")] - running[np.searchsorted(sorted_place, point - w)]
    some = value >= 0
    place, of_key, of_value = place[some], key[some], value[some]
    end = place + w + 1
    if len(place):
        same = (of_key[1:] == of_key[:-1]) & (of_value[1:] == of_value[:-1])
        end[:-1] = np.where(same, np.minimum(end[:-1], place[1:]), end[:-1])
    begin, end = np.sort(place), np.sort(end)
    first = q_key * span  # all keys before this one have as many ends as starts
    d = (np.searchsorted(begin, point, side="right") - np.searchsorted(begin, first)) - (
        np.searchsorted(end, point, side="right") - np.searchsorted(end, first))
    return frame, d


def behavioural(stream: DataFrame, rules: list[ru.Rule], delay: str = "30 seconds", buckets: int = 256) -> DataFrame:
    """Behavioural rules. State is kept per (rule, slice as long as the frame, hash bucket of the key): a packet goes to
    its own slice, and tracked packets also to the next one, which their frame can reach. So state is bounded, one entry
    per (key, value, microsecond), and is dropped by the watermark when the slice is over.
    Matches come out in the batch in which the packet arrives, judged on all that has arrived by then: a packet that is late, but
    within ``delay``, sees the sightings of its own frame, also where its values have been seen again since.
    ``buckets`` is the parallelism of a slice: each group costs a call per batch, so it should follow the number of cores, not the
    number of keys.
    """
    specs = [replace(s, slice_us=s.window_us) for s in (ru._spec(r) for r in rules if r.pattern_type == "behavioral")]
    limits = {s.rule.id: (s.threshold, s.by_distinct, s.window_us) for s in specs}
    rows = ru._touch_rows(stream.withWatermark("ts", delay), specs, False, ["ts", "pid", "src_ip", "dst_ip"])
    own = ru._slice_of("ts_us")
    last = F.when(F.col("tracked"), ru._slice_of(F.col("ts_us") + F.col("w"))).otherwise(own)
    rows = rows.withColumn("home", own).withColumn("slice", F.explode(F.sequence(own, last))).withColumn(
        "bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule, slice_no = group[0], int(group[1])
        threshold, distinct, w = limits[rule]
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches), ignore_index=True)
        seen = new.loc[new["tracked"], ["key", "value", "ts_us"]].rename(columns={"ts_us": "at"}).assign(n=1)
        if state.exists:
            seen = pd.concat([pd.DataFrame(dict(zip(("key", "value", "at", "n"), map(list, state.get)))), seen], ignore_index=True)
        seen = seen.groupby(["key", "value", "at"], dropna=False, as_index=False, sort=False)["n"].sum()
        codes, keys = pd.factorize(pd.concat([seen["key"], new["key"]], ignore_index=True))
        values, _ = pd.factorize(seen["value"])  # null is -1
        at, n, of_key = seen["at"].to_numpy(np.int64), seen["n"].to_numpy(np.int64), codes[:len(seen)]
        order = np.lexsort((at, values, of_key))
        points = new.assign(code=codes[len(seen):])
        points = points[(points["home"] == slice_no).to_numpy()]
        frame, d = frame_counts(of_key[order], values[order], at[order], n[order],
                                points["code"].to_numpy(np.int64), points["ts_us"].to_numpy(np.int64), w)
        if len(seen):
            state.update(tuple(seen[c].astype(object).where(seen[c].notna(), None).tolist() for c in ("key", "value", "at", "n")))
            state.setTimeoutTimestamp(max((slice_no + 1) * w // 1000, state.getCurrentWatermarkMs() + 1))
        points = points.assign(rule=rule, n=frame, d=d)
        yield points.loc[(d if distinct else frame) >= threshold, ["pid", "ts_us", "src_ip", "dst_ip", "rule", "n", "d"]]

    raw = rows.groupBy("rule", "slice", "bucket").applyInPandasWithState(
        run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == s.rule.id, f(s)) for s in specs])
    measure = pick(lambda s: F.col("d") if s.by_distinct else F.col("n"))
    return raw.select(
        "pid", "ts_us", F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("target_ip"), F.col("rule").alias("signature_id"),
        pick(lambda s: F.lit(s.rule.name)).alias("signature_name"), pick(lambda s: F.lit(s.rule.category)).alias("category"),
        pick(lambda s: F.lit(s.rule.severity)).alias("severity"),
        F.least(measure / (pick(lambda s: F.lit(s.rule.threshold or 10)) * 2), F.lit(1.0)).alias("confidence"),
        F.col("n").alias("frame_count"), F.col("d").alias("frame_distinct"))
