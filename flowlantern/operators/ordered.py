"""Sequential rules ("greedy" scans) over keyed, time-ordered rows, without gathering a key in one task.

Rows are range-partitioned by (key, time, id): a hot key is spread over as many tasks as its size needs, and the
tasks of a key are consecutive. Every task runs the rule over its sorted rows with bounded state. A partition that
begins inside a key needs the state its predecessor ended with, so there are two passes over the same partitions,
which are checkpointed to reliable storage in between.

The first pass writes one record per partition: its first and last key and what it does to the state. A partition
with a key border or a reset point (a pause after which the rule forgets the past) ends in one known state. A
partition that lies inside one key has a *transfer map* instead: the end state for every start state. Maps compose,
so they are merged on executors in a tree of groups of ``FAN``, up to the root and back down, and every partition
learns its start state after ``log_FAN(partitions)`` rounds. Records and start states are tables: the driver sees none of them.

The second pass emits the rows. The start state joins the first row of its partition only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.session import BROADCAST_ROWS, checkpointed, stored

FAN = 64  # a map is at most some megabytes


@dataclass
class Rows:
    """Consecutive rows in order: where a new key begins, the key of the last row, and the columns the rule reads."""

    new_key: np.ndarray
    last_key: Any
    columns: dict[str, np.ndarray]


class Rule(Protocol):
    """A sequential rule. A state is None or a picklable dict with at least ``key``."""

    key: str                      # key column
    needs: tuple[str, ...]        # columns the rule reads besides the key
    adds: str                     # DDL of the columns it adds

    def step(self, rows: Rows, state: dict | None) -> tuple[dict[str, np.ndarray], dict | None]:
        """New columns, and the state after the last row."""

    def transfer(self, columns: dict[str, np.ndarray]) -> Any | None:
        """Map of a block inside one key; None if the end state does not depend on the start state."""

    def apply(self, table: Any, key: Any, state: dict | None) -> dict: ...

    def compose(self, first: Any, second: Any) -> Any | None:
        """Map of both blocks; None if the pause between them makes the end state independent of the start state."""


def _rows(rule: Rule, batch: pa.RecordBatch, state: dict | None) -> Rows:
    keys = batch.column(batch.schema.get_field_index(rule.key)).fill_null("\0")
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    new[0] = state is None or state["key"] != keys[0].as_py()
    columns = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in rule.needs}
    return Rows(new, keys[len(keys) - 1].as_py(), columns)


def _emitted(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, state = None, None
    added = [f.split(" ")[0] for f in rule.adds.split(", ")]
    for batch in batches:
        if not len(batch):
            continue
        parts = batch.column(batch.schema.get_field_index("_part")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, given = parts[a], piece.column(piece.schema.get_field_index("_start"))[0]
                state = pickle.loads(given.as_py()) if given.is_valid else None
            new, state = rule.step(_rows(rule, piece, state), state)
            names = [n for n in piece.schema.names if n not in ("_part", "_start")]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(piece.schema.get_field_index(n)) for n in names), *(pa.array(new[n]) for n in added)], names=[*names, *added])


_RECORD = "node int, first_key string, last_key string, whole boolean, map binary"


def _record(node, first_key, last_key, whole, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int32()), pa.array([first_key], pa.string()), pa.array([last_key], pa.string()),
         pa.array([whole]), pa.array([pickle.dumps(value)], pa.binary())], names=["node", "first_key", "last_key", "whole", "map"])


def _summary(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The record of a partition. ``map`` is the transfer map if ``whole``, else the end state."""
    node = first = last = state = None
    whole: list | None = []
    for batch in batches:
        if not len(batch):
            continue
        found = _rows(rule, batch, None)
        if node is None:
            node = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
            first = batch.column(batch.schema.get_field_index(rule.key)).fill_null("\0")[0].as_py()
        last = found.last_key
        at = int(np.flatnonzero(found.new_key)[-1])  # rows of earlier keys cannot matter to the end state
        tail = batch.slice(at)
        if state is not None and state["key"] != last:
            state = None
        rows = _rows(rule, tail, state)
        _, state = rule.step(rows, state)
        if whole is not None and first == last:
            whole.append(rows.columns)
        else:
            whole = None
    if node is None:
        return
    table = rule.transfer({c: np.concatenate([w[c] for w in whole]) for c in rule.needs}) if whole else None
    yield _record(node, first, last, table is not None, state if table is None else table)


def _after(rule: Rule, r: dict, state: dict | None) -> dict:
    """State after the block of a record."""
    value = pickle.loads(r["map"])
    if not r["whole"]:
        return value
    return rule.apply(value, r["first_key"], state if state is not None and state["key"] == r["first_key"] else None)


def _merge(rule: Rule):
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        first, rest = rows[0], rows[1:]
        whole, value, last = first["whole"], pickle.loads(first["map"]), first["last_key"]
        for r in rest:
            if whole and r["whole"] and r["first_key"] == last:
                value = rule.compose(value, pickle.loads(r["map"]))
                if value is None:
                    whole, value = False, _after(rule, r, None)
            elif r["whole"]:
                state = value if not whole else None  # another key than the block before: it starts afresh
                whole, value = False, _after(rule, r, state)
            else:
                whole, value = False, pickle.loads(r["map"])
            last = r["last_key"]
        return pa.Table.from_batches([_record(key[0].as_py(), first["first_key"], last, whole, value)])

    return run


def _deal(rule: Rule):
    """Start states of the blocks of a group, from the start state of the group."""
    def deal(rows, state):
        nodes, starts = [], []
        for r in sorted(rows.to_pylist(), key=lambda r: r["node"]):
            nodes.append(r["node"])
            used = state is not None and state["key"] == r["first_key"]
            starts.append(pickle.dumps(state) if used else None)
            state = _after(rule, r, state)
        return pa.table([pa.array(nodes, pa.int32()), pa.array(starts, pa.binary())], names=["node", "start"])

    def top(key, table):
        return deal(table, None)

    def below(key, table, above):
        given = above["start"][0] if len(above) else None
        return deal(table, pickle.loads(given.as_py()) if given is not None and given.is_valid else None)

    return top, below


def start_states(rule: Rule, records: DataFrame, parts: int) -> DataFrame:
    """(node, start): the state each partition begins with, null where it begins with a new key."""
    levels, n = [records], parts
    up = F.call_function("div", F.col("node"), F.lit(FAN)).cast("int").alias("above")
    while n > FAN:
        levels.append(stored(levels[-1].groupBy(up).applyInArrow(_merge(rule), _RECORD), "records"))
        n = -(-n // FAN)
    top, below = _deal(rule)
    starts = levels[-1].groupBy(F.lit(0).alias("above")).applyInArrow(top, "node int, start binary")
    for level in reversed(levels[:-1]):
        starts = level.groupBy(up).cogroup(starts.groupBy("node")).applyInArrow(below, "node int, start binary")
    return starts


def ordered_scan(df: DataFrame, rule: Rule, order: list[str]) -> DataFrame:
    """``df`` with the columns that ``rule`` adds, applied per ``rule.key`` in the given order."""
    rows = df.repartitionByRange(rule.key, *order).sortWithinPartitions(rule.key, *order)
    # row numbers of a task start at 0 in the lower 33 bits
    first = (F.monotonically_increasing_id() % F.lit(1 << 33)) == 0
    rows = checkpointed(rows.select("*", F.spark_partition_id().alias("_part"), first.alias("_first")))
    conf = df.sparkSession.conf.get  # adaptive execution may merge partitions, so these are upper bounds of their number
    parts = max(int(conf("spark.sql.shuffle.partitions")), int(conf("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + rule.adds
    records = rows.select("_part", rule.key, *rule.needs).mapInArrow(lambda it: _summary(rule, it), _RECORD)
    if parts > FAN:  # read once on the way up and once on the way down
        records = stored(records, "records")
    starts = start_states(rule, records, parts).where("start is not null").select(
        F.col("node").alias("_part"), F.lit(True).alias("_first"), F.col("start").alias("_start"))
    if parts <= BROADCAST_ROWS:  # a state is some hundred bytes
        rows = rows.join(F.broadcast(starts), ["_part", "_first"], "left")
    else:
        rows = rows.join(starts, ["_part", "_first"], "left").repartition("_part").sortWithinPartitions("_part", rule.key, *order)
    return rows.select(*df.columns, "_part", "_start").mapInArrow(lambda it: _emitted(rule, it), ddl)
