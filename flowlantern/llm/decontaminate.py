"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with runs of white space as one blank. A passage is ``PASSAGE`` bytes of a benchmark item (shorter
items as a whole), and a document holds it if some region is within ``EDITS`` edits of it, five in a hundred bytes. Such a region
shares at least PASSAGE - Q + 1 - Q * EDITS of its q-grams with the passage, in a band of EDITS + 1 neighbouring diagonals. So, in turn:
positions where too few q-grams occur in the benchmark at all are passed over; the rest are counted by item and overlapping diagonal
bands; bands that reach the bound are verified by banded alignment.

The benchmark is taken in blocks of at most ``BLOCK_BYTES``, each a pass over the documents, so what is sent to tasks is bounded.

Defined cases: null and empty texts, and items with fewer than Q bytes, match nothing. Equal items are all reported. An item without
id is reported as -1. Further columns stay as they are; a column of the result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlantern.llm import blocks

Q = 8
PASSAGE = 64
BLOCK_BYTES = 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[blocks.SPACE] = 0x20


def edits(length: int) -> int:
    return length // 20


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return data, offsets
    space = blocks.SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return _FOLD[data[keep]], at[offsets]


def qgrams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def _bit(codes: np.ndarray) -> np.ndarray:
    return ((codes * blocks.BASE) >> np.uint64(43)).astype(np.int64)


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        self.texts, self.ids, codes, item, place = [], [], [], [], []
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b, _ = normalised(raw, np.array([0, len(raw)]))
            b = np.frombuffer(b.tobytes().strip(b" "), np.uint8)
            if len(b) < Q:
                continue
            c = qgrams(b)
            codes.append(c)
            item.append(np.full(len(c), len(self.texts), np.int32))
            place.append(np.arange(len(c), dtype=np.int32))
            self.texts.append(b.tobytes())
            self.ids.append(-1 if key is None else key)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int32)
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(codes)))
        self.bits = np.zeros(1 << 21, bool)
        self.bits[_bit(self.codes)] = True
        self.least = min((self.bound(len(t)) for t in self.texts), default=1)
        self.longest = max((min(PASSAGE, len(t)) for t in self.texts), default=0)
        self.k = edits(PASSAGE)

    @staticmethod
    def bound(length: int) -> int:
        n = min(PASSAGE, length)
        return max(1, n - Q + 1 - Q * edits(n))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[set[int]]:
        """Items found in each text."""
        found: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        if not self.texts:
            return found
        data, offsets = normalised(data, offsets)
        codes = qgrams(data)
        if not len(codes):
            return found
        hit = self.bits[_bit(codes)]
        tail = (offsets[1:, None] - np.arange(1, Q)[None, :]).ravel()  # q-grams do not cross texts
        hit[tail[(tail >= 0) & (tail < len(hit))]] = False
        # regions with too few q-grams of any item cannot hold a passage
        span = self.longest - Q + 1 + self.k
        total = np.concatenate(([0], np.cumsum(hit)))
        n = len(hit)
        dense = total[np.minimum(np.arange(n) + span, n)] - total[:-1] >= self.least
        starts, ends = blocks.runs(dense, np.zeros(0, np.int64))
        if not len(starts):
            return found
        near = blocks.covered(n, starts, np.minimum(ends + span, n)) & hit
        at = np.flatnonzero(near)
        k = np.searchsorted(self.codes, codes[at])
        ok = k < len(self.codes)
        ok[ok] = self.codes[k[ok]] == codes[at][ok]
        at, k = at[ok], k[ok]
        doc = np.searchsorted(offsets, at, "right") - 1
        for lo, hi in blocks.slices(np.concatenate(([0], np.cumsum(self.count[k]))), 1 << 21):
            # slices end between texts
            lo = int(np.searchsorted(doc, doc[lo])) if lo else 0
            if hi < len(doc):
                hi = int(np.searchsorted(doc, doc[hi - 1], "right"))
            self._bands(data, offsets, at[lo:hi], k[lo:hi], doc[lo:hi], found)
        return found

    def _bands(self, data, offsets, at, k, doc, found) -> None:
        n = self.count[k]
        post = blocks.ranges(self.first[k], n)
        item, place = self.item[post].astype(np.int64), self.place[post].astype(np.int64)
        where, of = np.repeat(at, n), np.repeat(doc, n)
        wide = self.k + 1
        diagonal = where - offsets[of] - place + (1 << 20)
        for shift in (0, 1):  # bands of 2 * wide diagonals, overlapping by half: any wide neighbouring ones share a band
            band = (diagonal + shift * wide) // (2 * wide)
            order = np.lexsort((where, place, band, item, of))
            o, i, b, p, w = of[order], item[order], band[order], place[order], where[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(new) - 1
            fresh = new.copy()
            fresh[1:] |= p[1:] != p[:-1]  # a q-gram of the item counts once
            g, p, w, o, i = group[fresh], p[fresh], w[fresh], o[fresh], i[fresh]
            key = g * (1 << 22) + p
            size = np.array([len(t) for t in self.texts])[i]
            length = np.minimum(PASSAGE, size)
            upto = np.searchsorted(key, key + length - Q + 1)
            need = np.maximum(1, length - Q + 1 - Q * (length // 20))
            base = band[order][fresh] * 2 * wide - shift * wide - (1 << 20)  # the lowest diagonal of the band
            tried: set[int] = set()
            last = -1
            for x in np.flatnonzero(upto - np.arange(len(g)) >= need).tolist():
                d, it = int(o[x]), int(i[x])
                if self.ids[it] in found[d]:
                    continue
                if g[x] != last:
                    tried, last = set(), int(g[x])
                text, m, at = self.texts[it], int(length[x]), int(p[x])
                most = edits(m)
                # edits can spoil the first Q * most q-grams of a passage; the last passage of an item ends with it
                for j in range(min(at, len(text) - m), max(0, at - Q * most) - 1, -1):
                    if j in tried:
                        continue
                    tried.add(j)
                    lo = int(offsets[d]) + j + int(base[x])
                    lo, hi = max(int(offsets[d]), lo - most), min(int(offsets[d + 1]), lo + m + 2 * wide - 1 + most)
                    if banded(text[j:j + m], data[lo:hi].tobytes(), most):
                        found[d].add(self.ids[it])
                        break


def banded(pattern: bytes, region: bytes, most: int) -> bool:
    """Is some part of the region within ``most`` edits of the pattern? Cells beyond the region's slack have no place in the band."""
    slack = len(region) - len(pattern) + most
    if slack < 0 or not pattern:
        return False
    if pattern in region:
        return True
    if most == 0:
        return False
    far = most + 1
    row = [0] * (len(region) + 1)  # a match may start anywhere
    for i, c in enumerate(pattern, 1):
        last, lo, hi = row, max(1, i - most), min(len(region), i + slack)
        row = [far] * (len(region) + 1)
        row[lo - 1] = i if lo == 1 else far
        best = far
        for j in range(lo, hi + 1):
            v = last[j - 1] + (region[j - 1] != c)
            v = min(v, last[j] + 1, row[j - 1] + 1, far)
            row[j] = v
            best = min(best, v)
        if best == far and row[lo - 1] >= far:
            return False
    return min(row) <= most


def flagged(docs: DataFrame, benchmark: DataFrame, column: str = "benchmark_items", text: str = "text") -> DataFrame:
    """Adds ``column``: the sorted ids of the benchmark items of which a passage occurs in the text (empty: clean)."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = max(1, -(-blocks.text_bytes(bench) // BLOCK_BYTES))
    out = docs.drop(column)
    schema = T.StructType([*out.schema.fields, T.StructField(column, T.ArrayType(T.LongType()))])
    for b in range(n):
        items = sorted(((r["item_id"], r["text"]) for r in bench.where(blocks.batch_of(n, "text") == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

        def run(batches, items=items, first=b == 0):
            index = Index(items)
            for batch in batches:
                data, offsets = blocks.utf8(batch.column(batch.schema.get_field_index(text)))
                hits: list[list[int]] = []
                for lo, hi in blocks.slices(offsets):
                    hits += [sorted(s) for s in index.search(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])]
                if first:
                    columns, names = list(batch.columns), list(batch.schema.names)
                else:
                    before = batch.column(batch.num_columns - 1).to_pylist()
                    hits = [sorted({*x, *y}) for x, y in zip(before, hits)]
                    columns, names = list(batch.columns)[:-1], list(batch.schema.names)[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.int64()))], names=[*names, column])

        out = out.mapInArrow(run, schema)
    return out
