"""At most ``limit`` rows of a key may pass within any ``window_us``: a row passes if fewer passed in the window before it.

With ``N`` the number of rows passed so far, row i gives ``N[i] = min(N[i-1] + 1, N[j] + limit)``, where j is the last row more
than a window before i. That is linear over (min, +), so what a block does to the start state follows from what it does to one
constraint ``N[r] = 0`` at a time: a *fresh run* of the rule that begins after row r. The start state (times of the last rows passed) is
at most ``limit`` such constraints, each at a row within one window of the block's begin. The transfer map therefore holds, for every
such row r, how many rows a fresh run passes and the times of its last ones; equal neighbours are stored once. The passed rows under
several constraints are the level-wise latest of those under each. Maps compose by applying the second to the end states of the first.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

from flowlantern.operators.ordered import Rows

NEVER = np.iinfo(np.int64).min // 4  # before all times


@dataclass(frozen=True)
class SlidingLimit:
    """The rule. State: times of the last ``limit`` rows that passed.

    Fields of the transfer map: first and last (times of the block); per fresh run, in time order, times (of the row after which it begins; the
    first: before the block), passed (number of rows) and tail (times of the last ones, right-aligned, NEVER where there are fewer).
    """

    limit: int
    window_us: int
    key: str
    flag: str                       # the boolean column added: true for rows that do not pass
    time: str = "ts_us"

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.time,)

    @property
    def adds(self) -> str:
        return f"{self.flag} boolean"

    def step(self, rows: Rows, state: dict | None):
        ts = rows.columns[self.time]
        n = len(ts)
        stopped = np.zeros(n, bool)
        begin = np.flatnonzero(rows.new_key)
        carried = not rows.new_key[0]
        if carried:
            begin = np.concatenate(([0], begin))
        end = np.append(begin[1:], n)
        # rows with ``limit`` others of their key in the window before them: only their keys need a scan
        near = np.zeros(n, bool)
        if n > self.limit:
            near[self.limit:] = ts[self.limit:] - ts[:-self.limit] <= self.window_us
        seg = np.repeat(begin, end - begin)
        near &= np.arange(n) - seg >= self.limit
        scan = np.logical_or.reduceat(near, begin) if n else near
        passed = deque(state["passed"]) if carried else deque()
        for k in np.flatnonzero(scan | ((np.arange(len(begin)) == 0) & carried)).tolist():
            a, b = int(begin[k]), int(end[k])
            queue = passed if k == 0 and carried else deque()
            self._scan(ts, a, b, queue, stopped)
        a = int(begin[-1])
        if len(begin) == 1 and carried:
            last = list(passed)
        else:
            last = ts[a:][~stopped[a:]][-self.limit:].tolist()
        return {self.flag: stopped}, {"key": rows.last_key, "passed": last[-self.limit:]}

    def _scan(self, ts, a, b, queue, stopped):
        while a < b:
            t = int(ts[a])
            while queue and queue[0] < t - self.window_us:
                queue.popleft()
            if len(queue) >= self.limit:
                # nothing passes until the oldest one leaves the window: skip to there
                to = a + int(np.searchsorted(ts[a:b], queue[0] + self.window_us, side="right"))
                stopped[a:to] = True
                a = to
            else:
                queue.append(t)
                a += 1

    def transfer(self, columns: dict[str, np.ndarray]) -> dict | None:
        ts = columns[self.time]
        n, k = len(ts), self.limit
        if (np.diff(ts) > self.window_us).any():
            return None  # after such a pause nothing is remembered
        head = int(np.searchsorted(ts, ts[0] + self.window_us, side="right"))
        sources = np.concatenate(([-1], np.flatnonzero(np.append(ts[1:head] != ts[:head - 1], True))))  # the last of equal times
        nxt = np.append(np.searchsorted(ts, ts + self.window_us, side="right"), n)
        passed = np.zeros(len(sources), np.int64)
        tail = np.full((len(sources), k), NEVER, np.int64)
        recent = [np.minimum(sources + 1 + q, n) for q in range(k)]  # the first rows of a fresh run pass
        live = np.arange(len(sources))
        turn = 0
        while len(live):
            row = recent[turn % k]
            if turn >= k:
                row = np.maximum(np.minimum(recent[(turn - 1) % k] + 1, n), nxt[row])
                recent[turn % k] = row
            here = row[live] < n
            live = live[here]
            tail[live, turn % k] = ts[row[live]]
            passed[live] += 1
            turn += 1
        # the ring of a run that passed p rows ends at place p % limit
        order = (passed[:, None] + np.arange(k)) % k
        tail = np.take_along_axis(tail, order, axis=1)
        return self._packed(int(ts[0]), int(ts[-1]), np.concatenate(([NEVER], ts[sources[1:]])), passed, tail)

    @staticmethod
    def _packed(first, last, times, passed, tail) -> dict:
        """Equal neighbours once: a lookup takes the last run that begins by a time, so the first of them stays."""
        keep = np.ones(len(times), bool)
        keep[1:] = (passed[1:] != passed[:-1]) | (tail[1:] != tail[:-1]).any(axis=1)
        return {"first": first, "last": last, "times": times[keep], "passed": passed[keep], "tail": tail[keep]}

    def _applied(self, m: dict, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that pass, and the last times passed, for start states [s, limit] (right-aligned)."""
        k, s = self.limit, len(states)
        runs = np.zeros((s, k + 1), np.int64)  # constraint 0: nothing more than what passed before the block
        for q in range(k):
            runs[:, q + 1] = np.maximum(np.searchsorted(m["times"], states[:, q] + self.window_us, side="right") - 1, 0)
        value = np.concatenate(([0], np.arange(k)))
        count = (value + m["passed"][runs]).min(axis=1)
        out = np.full((s, k), NEVER, np.int64)
        for d in range(k):
            level = count - d
            for c in range(k + 1):
                at = k - 1 - (m["passed"][runs[:, c]] - (level - value[c]))  # place of the level in the tail of this run
                known = (at >= 0) & (level - value[c] > 0)
                out[known, k - 1 - d] = np.maximum(out[known, k - 1 - d], m["tail"][runs[known, c], at[known]])
            old = level <= 0  # passed before the block
            out[old, k - 1 - d] = states[old, np.maximum(k - 1 + level[old], 0)]
            out[level <= -k, k - 1 - d] = NEVER
        return count, out

    def apply(self, table: dict, key, state: dict | None) -> dict:
        given = np.full((1, self.limit), NEVER, np.int64)
        if state is not None and state["passed"]:
            given[0, self.limit - len(state["passed"]):] = state["passed"]
        _, after = self._applied(table, given)
        return {"key": key, "passed": [int(t) for t in after[0] if t > NEVER]}

    def compose(self, first: dict, second: dict) -> dict:
        more, tail = self._applied(second, first["tail"])
        # the window behind the begin of the first block may reach into the second, where a row of equal time comes later
        late = (second["times"] >= first["last"]) & (second["times"] <= first["first"] + self.window_us)
        return self._packed(first["first"], second["last"], *(
            np.concatenate((x, second[c][late]))
            for c, x in (("times", first["times"]), ("passed", first["passed"] + more), ("tail", tail))))
