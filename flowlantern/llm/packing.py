"""Packing into sequences of fixed size: first fit decreasing with a tournament tree, in randomised groups of documents.

A document is its ids and an end id. Full sequences are cut off it first; what remains is dealt with its group by first fit
decreasing: a tournament tree over the free space of all open sequences finds the first that fits in logarithmic time. Then gaps are
closed with pieces of the emptiest sequences, so that at most one sequence of a group is not full, and that one is cut at powers
of two, which need no padding. Groups are independent tasks, dealt by hash, of about ``GROUP`` documents.

Defined cases: a null or empty text is its end id alone; rows without id or with equal ids are packed like others. Empty input gives
no pieces. Further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks, tokens

GROUP = 1024
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free space of sequences; the winner of each inner node is its largest."""

    def __init__(self, n: int, size: int):
        self.n = 1 << max(0, (n - 1).bit_length())
        self.tree = [size] * (2 * self.n)

    def first_fit(self, need: int) -> int:
        k = 1
        while k < self.n:
            k = 2 * k if self.tree[2 * k] >= need else 2 * k + 1
        return k - self.n

    def use(self, leaf: int, amount: int) -> None:
        k = leaf + self.n
        self.tree[k] -= amount
        while k > 1:
            k >>= 1
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def free(self, leaf: int) -> int:
        return self.tree[leaf + self.n]


def pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    out, seq = [], 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((d, start, size, seq, 0))
            seq += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    rest.sort(key=lambda r: (-r[0], r[1]))
    tree = Tournament(max(1, len(rest)), size)
    bins: list[list[tuple[int, int, int]]] = []
    for n, d, start in rest:
        b = tree.first_fit(n)
        tree.use(b, n)
        while b >= len(bins):
            bins.append([])
        bins[b].append((d, start, n))
    # the emptiest sequences give their pieces to the gaps of the fullest
    order = sorted(range(len(bins)), key=lambda b: (tree.free(b), b))
    lo, hi = 0, len(order) - 1
    gap = [tree.free(b) for b in range(len(bins))]
    while lo < hi:
        to, giver = order[lo], order[hi]
        if gap[to] == 0:
            lo += 1
        elif not bins[giver]:
            hi -= 1
        else:
            d, start, n = bins[giver].pop()
            m = min(n, gap[to])
            if m < n:
                bins[giver].append((d, start, n - m))
            bins[to].append((d, start + n - m, m))
            gap[to] -= m
            gap[giver] += m
    for b in order:
        used = size - gap[b]
        if not used:
            continue
        # a sequence that is not full is cut at the powers of two of its length
        steps = [size] if used == size else [1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1]
        room, at = steps.pop(0), 0
        for d, start, n in bins[b]:
            while n:
                m = min(n, room - at)
                out.append((d, start, m, seq, at))
                start, n, at = start + m, n - m, at + m
                if at == room:
                    seq, at = seq + 1, 0
                    room = steps.pop(0) if steps else 0
    return out


def packed(docs: DataFrame, tokenizer: str, end: int, size: int = 2048, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // GROUP))

    def encode(batches):
        for batch in blocks.freed(batches):
            ids, sizes = [], []
            for lo, hi, i, at in tokens.batches(batch.column(1), tokenizer, end):
                ids.extend(i[at[k]:at[k + 1]].astype("<u4").tobytes() for k in range(hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["doc_id", "ids", "grp"])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x, "<u4") for x in group.column("ids").to_pylist()]
        key, g = group.column("doc_id").to_pylist(), group.column("grp")[0].as_py()
        found = pack([len(x) for x in ids], size)
        return pa.table({
            "doc_id": pa.array([key[p[0]] for p in found], pa.int64()), "start": pa.array([p[1] for p in found], pa.int64()),
            "length": pa.array([p[2] for p in found], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(ids[p[0]][p[1]:p[1] + p[2]].tobytes()) for p in found], pa.int64()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in found], pa.int64()),
            "sequence_id": pa.array([(g << 32) + p[3] for p in found], pa.int64()), "offset": pa.array([p[4] for p in found], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), blocks.batch_of(groups, "doc_id", text).alias("grp"))
    return (rows.mapInArrow(encode, "doc_id long, ids binary, grp int").groupBy("grp").applyInArrow(run, _SCHEMA))
