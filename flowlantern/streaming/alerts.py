"""Alerts over a stream: admission with keyed state, delivery with retries."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlantern.config import DEFAULTS, Thresholds

@dataclass(frozen=True)
class AdmissionRule:
    """Rate limit per (source, type), then de-duplication per (source, type, priority), in time order: both rules of
    :func:`flowlantern.operators.alerts.admission` in one pass, for state that is kept per key between micro-batches.
    """

    limit: int | None
    limit_us: int
    dedup_us: int | None
    out_schema: str
    key: str = "admission_key"
    needs: tuple[str, ...] = ("ts_us", "alert_id", "priority")

    def step(self, pdf: pd.DataFrame, state: dict | None):
        ts, keys, prio = pdf["ts_us"].to_numpy(), pdf[self.key].to_numpy(), pdf["priority"].to_numpy()
        reset = max(self.limit_us, self.dedup_us or 0)
        key, last, anchored = (state["key"], state["last"], state["anchored"]) if state else (None, None, False)
        passed = deque(state["passed"]) if state else deque()
        kept = dict(state["kept"]) if state else {}
        n = len(ts)
        limited, duplicate = np.zeros(n, bool), np.zeros(n, bool)
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), n]):
            if keys[a] != key:
                anchored = a > 0 or state is not None
                key, last, passed, kept = keys[a], int(ts[a]), deque(), {}
            i = a
            while i < b:
                t = int(ts[i])
                if t - last > reset:
                    passed.clear()
                    kept.clear()
                    anchored = True
                last = t
                if self.limit is not None:
                    while passed and passed[0] < t - self.limit_us:
                        passed.popleft()
                    if len(passed) >= self.limit:
                        # nothing passes until the oldest one leaves the frame: skip to there
                        j = i + int(np.searchsorted(ts[i:b], passed[0] + self.limit_us, side="right"))
                        limited[i:j] = True
                        last, i = int(ts[j - 1]), j
                        continue
                    passed.append(t)
                if self.dedup_us is not None:
                    if prio[i] in kept and t - kept[prio[i]] < self.dedup_us:
                        duplicate[i] = True
                    else:
                        kept[prio[i]] = t
                i += 1
        out = pdf.drop(columns=["_part"], errors="ignore").assign(rate_limited=limited, duplicate=duplicate)
        live = {p: t for p, t in kept.items() if last - t < (self.dedup_us or 0)}
        after = {"key": key, "last": last, "passed": [t for t in passed if t >= last - self.limit_us],
                 "kept": dict(sorted(live.items())), "anchored": anchored}
        return out, after


_STATE = "last bigint, passed array<bigint>, names array<string>, times array<bigint>"


def admit(stream: DataFrame, delay: str = "30 seconds", th: Thresholds = DEFAULTS) -> DataFrame:
    """The batch admission rule over an alert stream (columns ts, ts_us, alert_id, source_ip, attack_type, priority, ...).

    State per (source, type): at most ten times and one time per priority; dropped when both frames are over.
    Rows of a micro-batch are put in time order per key.
    """
    cols = [f for f in stream.schema.fields if f.name != "ts"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols) + ", rate_limited boolean, duplicate boolean"
    rule = AdmissionRule(th.rate_limit, th.rate_window_us, th.dedup_window_us, ddl)
    names = [f.name for f in cols]
    memory_ms = max(th.rate_window_us, th.dedup_window_us) // 1000

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = None
        if state.exists:
            last, passed, kept, times = state.get
            before = {"key": key[0], "last": last, "passed": list(passed), "kept": dict(zip(kept, times)), "anchored": False}
        pdf = pd.concat(list(batches)).sort_values(["ts_us", "alert_id"])
        out, after = rule.step(pdf, before)
        state.update((after["last"], after["passed"], list(after["kept"]), list(after["kept"].values())))
        state.setTimeoutTimestamp(max(after["last"] // 1000 + memory_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield out[[*names, "rate_limited", "duplicate"]]

    rows = stream.withWatermark("ts", delay).withColumn("admission_key", F.concat_ws("|", "source_ip", "attack_type"))
    return rows.groupBy("admission_key").applyInPandasWithState(
        run, ddl, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def deliver(messages: DataFrame, send: Callable[[str, str, str], None], retries: int = 3) -> DataFrame:
    """Try to send each (alert_id, channel, message) up to ``retries`` times; one result row per attempt series.

    ``send`` runs in the tasks and raises on failure. A re-run task sends again, so receivers should key on alert_id.
    """
    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for alert_id, channel, message in zip(pdf["alert_id"], pdf["channel"], pdf["message"]):
                error, tries = None, 0
                for tries in range(max(retries, 1)):
                    try:
                        send(str(alert_id), channel, message)
                        error = None
                        break
                    except Exception as e:
                        error = str(e)
                rows.append((str(alert_id), channel, error is None, tries, error))
            yield pd.DataFrame(rows, columns=["alert_id", "channel", "success", "retry_count", "error"])

    return messages.select("alert_id", "channel", "message").mapInPandas(
        part, "alert_id string, channel string, success boolean, retry_count bigint, error string")
