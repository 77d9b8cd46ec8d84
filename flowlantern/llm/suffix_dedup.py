"""Exact substring deduplication of bytes by a hash-compared suffix sort.

A byte goes if some string of ``SPAN`` bytes around it also starts earlier: in a smaller doc_id, or before in the same document.

Suffixes are sorted where a repeat is possible only. Each window of SPAN bytes has an anchor, the leftmost place of its smallest 32-byte
hash; equal windows have equal anchors at the same offset. Documents are dealt to batches of bounded size, which ask in one exchange which
anchors occur twice, and send the surroundings of those (168 bytes at most) to the bucket of the anchor's hash. A bucket sorts the texts
after the anchors, and the reversed texts before them, by mergesort: a comparison finds the common extension of two suffixes by
binary search over prefix polynomial hashes, so it takes logarithmic time. Of occurrences that are alike in all their bytes and windows only the
first is sorted, the others repeat it. Common prefixes of sorted neighbours are verified byte by byte, and a collision repeats the sort with another base. Two windows are equal when they agree to the left and to the right of their anchors, so
classes of both sorted orders name them, and all but the earliest of each name are repeats.

Whole copies of a text would fill buckets with what is known: all but the first of equal texts are left out of the sort and lose all
their bytes (none below SPAN bytes); whatever they hold also starts in the first one.

Defined cases: null and empty texts have no bytes. Rows without id neither give nor lose bytes. Rows that repeat id and text are
one document; rows with one id and different texts are compared in the order of their hashes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks
from flowlantern.llm.debruijn import _answers, _deal, _find, _many, _resolve
from flowlantern.llm.graph import stored

SPAN = 100
KMER = 32
CHUNK = 4096
U = np.uint64
_BLOCKS = "bucket int, b int, keys binary, before binary, after binary, many binary"
_ANSWERS = "b int, keys binary, flags binary"
_SEGMENTS = "bucket int, b int, keys binary, ids binary, rows binary, places binary, left binary, right binary, low binary, high binary, text binary"
_LOST = "b int, rows binary, starts binary, ends binary"


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 32 bytes from each place."""
    if len(data) < KMER:
        return np.zeros(0, U)
    x = data.astype(U)
    for step in (1, 2, 4):
        x = (x[:-step] << U(8 * step)) | x[step:]
    n = len(data) - KMER + 1
    h = blocks.mix(x[:n] + blocks.BASE)
    for i in (8, 16, 24):
        h = blocks.mix(h * blocks.BASE ^ x[i:n + i])
    return h


def _sliding(h: np.ndarray, n: int, best) -> np.ndarray:
    """best over n consecutive values, by doubling."""
    m, size = h, 1
    while 2 * size <= n:
        m, size = best(m[:-size], m[size:]), 2 * size
    return best(m[:len(h) - n + 1], m[n - size:][:len(h) - n + 1]) if n > size else m


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of the anchors of the windows that lie inside one text."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none.astype(U), none, none
    h = kmer_hashes(data)
    w = SPAN - KMER + 1
    low = _sliding(h, w, np.minimum)
    i = blocks.ranges(offsets[:-1], np.maximum(np.diff(offsets) - SPAN + 1, 0))
    if not len(i):
        return none, none.astype(U), none, none
    top = _sliding(np.concatenate((np.zeros(w - 1, U), low, np.zeros(w - 1, U))), w, np.maximum)
    a = np.flatnonzero(h == top)
    at = np.searchsorted(a, i)
    want = low[i]
    open_ = np.flatnonzero(h[a[at]] != want)
    while len(open_):
        at[open_] += 1
        open_ = open_[h[a[at[open_]]] != want[open_]]
    p = a[at]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1))))
    last = np.append(new[1:], len(p)) - 1
    return p[new], h[p[new]], i[new], i[last]


class Suffixes:
    """Rows of bytes (at most ``width`` each) as words of eight, the first byte highest, with prefix polynomial hashes of the words."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, step: int, base: int):
        m, n = len(starts), -(-width // 8)
        self.lengths, self.words, self.hash = lengths, np.zeros((m, n), U), np.zeros((m, n + 1), U)
        power = np.multiply.accumulate(np.concatenate(([U(1)], np.full(n - 1, U(base), U))))
        i = np.arange(8 * n)[None, :]
        for lo in range(0, m, CHUNK):  # a row of places or products is some times as wide as what is kept
            hi = min(lo + CHUNK, m)
            at = np.clip(starts[lo:hi, None] + step * i, 0, max(0, len(text) - 1))
            part = np.where(i < lengths[lo:hi, None], text[at], 0).astype(np.uint8)
            self.words[lo:hi] = part.view(">u8")
            np.cumsum(blocks.mix(self.words[lo:hi] + U(1)) * power[None, :], axis=1, out=self.hash[lo:hi, 1:])

    def only(self, rows: np.ndarray) -> Suffixes:
        out = object.__new__(Suffixes)
        out.lengths, out.words, out.hash = self.lengths[rows], self.words[rows], self.hash[rows]
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search over the prefix hashes."""
        n = self.words.shape[1]
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), n)
        while True:
            go = lo < hi
            if not go.any():
                break
            mid = (lo + hi + 1) >> 1
            same = self.hash[x, mid] == self.hash[y, mid]
            lo, hi = np.where(go & same, mid, lo), np.where(go & ~same, mid - 1, hi)
        # the equal leading bytes of the first word that differs
        k = np.minimum(lo, n - 1)
        rest = self.words[x, k] ^ self.words[y, k]
        more = np.where(lo < n, 0, 8)
        for half in (4, 2, 1):
            zero = rest >> U(64 - 8 * half) == 0
            more = np.where(zero & (lo < n), more + half, more)
            rest = np.where(zero, rest << U(8 * half), rest)
        return np.minimum(np.where(lo < n, 8 * lo + more, 8 * n), np.minimum(self.lengths[x], self.lengths[y]))

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ended = n >= np.minimum(self.lengths[x], self.lengths[y])
        k = np.minimum(n >> 3, self.words.shape[1] - 1)
        return np.where(ended, self.lengths[x] < self.lengths[y], self.words[x, k] < self.words[y, k])

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the rows within their groups (rows of a group are neighbours), and common prefixes with the row before (-1: new group)."""
        m = len(group)
        order = np.arange(m)
        new = np.concatenate(([True], group[1:] != group[:-1])) if m else np.zeros(0, bool)
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        base, size = first[number], np.diff(np.append(first, m))[number]
        width = 1
        while m and width < size.max():
            at = np.flatnonzero(size > width)
            i = at - base[at]
            run = i // (2 * width) * (2 * width)
            left = i - run < width
            start = np.where(left, run + width, run)
            stop = np.minimum(np.where(left, run + 2 * width, run + width), size[at])
            start = np.minimum(start, stop)
            lo, hi = start.copy(), stop.copy()
            me = order[at]
            while True:
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                mid = (lo[go] + hi[go]) >> 1
                other = order[base[at[go]] + mid]
                # a row of the left run goes before equal ones of the right run
                before = np.where(left[go], self.less(other, me[go]), ~self.less(me[go], other))
                lo[go] = np.where(before, mid + 1, lo[go])
                hi[go] = np.where(before, hi[go], mid)
            own = np.where(left, i - run, i - run - width)
            out = order.copy()
            out[base[at] + run + own + lo - start] = me
            order = out
            width *= 2
        lcp = np.full(m, -1, np.int64)
        inner = np.flatnonzero(~new)
        lcp[inner] = self.common(order[inner - 1], order[inner])
        return order, lcp

    def verified(self, order: np.ndarray, lcp: np.ndarray) -> bool:
        """Do the common prefixes hold byte by byte?"""
        for lo in range(0, len(order), CHUNK):
            k = np.arange(max(1, lo), min(len(order), lo + CHUNK))
            k = k[lcp[k] > 0]
            if not self.agree(order[k - 1], order[k], lcp[k]):
                return False
        return True

    def agree(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Are the first ``n`` bytes of all rows x and y the same?"""
        differ = self.words[x] ^ self.words[y]
        left = np.clip(n[:, None] - 8 * np.arange(differ.shape[1])[None, :], 0, 8)  # bytes of each word that count
        return not (differ >> (8 * (8 - np.maximum(left, 1))).astype(U))[left > 0].any()


def _twins(keys, left, right, low, high, after: Suffixes, before: Suffixes) -> np.ndarray | None:
    """The first row with the key, windows and bytes of each row; None where hashes collide."""
    code = blocks.mix(keys + blocks.BASE * after.hash[:, -1])
    code = blocks.mix(code * blocks.BASE + before.hash[:, -1])
    code = blocks.mix(code * blocks.BASE + ((left << 24) | (right << 16) | (low << 8) | high).astype(U))
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    twin = first[number]
    if not all((v == v[twin]).all() for v in (keys, left, right, low, high)):
        return None
    for lo in range(0, len(keys), CHUNK):
        x, y = np.arange(lo, min(len(keys), lo + CHUNK)), twin[lo:lo + CHUNK]
        if not ((after.words[x] == after.words[y]).all() and (before.words[x] == before.words[y]).all()):
            return None
    return twin


def repeats(keys, ids, places, left, right, low, high, text, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors sorted by (key, id, place): which have a repeated window, and the first and the end byte covered.

    ``left`` and ``right`` bytes of text lie before and from each anchor, whose place in ``text`` is ``starts``; its windows start
    ``low`` to ``high`` bytes before it.
    """
    reach = SPAN - KMER
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407):
        after, before = Suffixes(text, starts, right, SPAN, 1, base), Suffixes(text, starts - 1, left, reach, -1, base)
        twin = _twins(keys, left, right, low, high, after, before)
        if twin is None:
            continue
        # later rows that are wholly like an earlier one repeat all its windows: one of each kind is sorted
        own = np.flatnonzero(twin == np.arange(len(keys)))
        after, before = after.only(own), before.only(own)
        o1, l1 = after.sort(keys[own])
        o2, l2 = before.sort(keys[own])
        if after.verified(o1, l1) and before.verified(o2, l2):
            break
    else:
        raise ValueError("prefix hashes collide under every base")
    m = len(own)
    near, far = low[own], high[own]
    first, last = np.full(m, 1 << 30), np.full(m, -1)
    name1, name2 = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(reach + 1):
        at = np.flatnonzero((near <= j) & (j <= far))
        if not len(at):
            continue
        name1[o1] = np.cumsum(l1 < SPAN - j)
        name2[o2] = np.cumsum(l2 < j)
        name = name1[at] * (m + 1) + name2[at]
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        again = at[order[1:][ranked[1:] == ranked[:-1]]]
        first[again] = np.minimum(first[again], j)
        last[again] = np.maximum(last[again], j)
    least, most = low.copy(), high.copy()  # of a row like an earlier one; those of the sorted rows follow
    least[own], most[own] = first, last
    return most >= 0, places - most, places - least + SPAN


def _pack(values, cuts):
    return pa.array([values[c].tobytes() for c in cuts], pa.binary())


def _sorted_bucket(group: pa.Table) -> pa.Table:
    get = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in group.column(c)]
    part = get("keys", U)
    b = np.repeat(np.array(group.column("b").to_pylist()), [len(x) for x in part])
    keys, ids, rows, places = np.concatenate(part), *(np.concatenate(get(c, np.int64)) for c in ("ids", "rows", "places"))
    left, right, low, high = (np.concatenate(get(c, np.uint8)).astype(np.int64) for c in ("left", "right", "low", "high"))
    text = np.concatenate(get("text", np.uint8))
    ends = np.cumsum(left + right)
    starts = ends - right
    order = np.lexsort((places, rows, ids, keys))
    k = keys[order]
    alone = np.concatenate(([True], k[1:] != k[:-1])) & np.concatenate((k[1:] != k[:-1], [True]))
    order = order[~alone]
    out_b, out_rows, out_s, out_e = [], [], [], []
    # groups of anchors in slices of bounded size; one very frequent anchor is a slice of its own
    k = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    edge = np.append(edge, len(k))
    lo = 0
    while lo < len(k):
        hi = int(edge[max(np.searchsorted(edge, lo, "right"), np.searchsorted(edge, lo + 50_000, "right") - 1)])
        o = order[lo:hi]
        hit, s, e = repeats(keys[o], ids[o], places[o], left[o], right[o], low[o], high[o], text, starts[o])
        out_b.append(b[o][hit]), out_rows.append(rows[o][hit]), out_s.append(s[hit]), out_e.append(e[hit])
        lo = hi
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ob, orow, os_, oe = map(cat, (out_b, out_rows, out_s, out_e))
    order = np.argsort(ob, kind="stable")
    own, at = np.unique(ob[order], return_index=True)
    cuts = [order[x:y] for x, y in zip(at, np.append(at[1:], len(order)))]
    return pa.table({"b": pa.array(own, pa.int32()), "rows": _pack(orow, cuts), "starts": _pack(os_, cuts), "ends": _pack(oe, cuts)})


def _parts(table):
    """Texts of a batch that take part, in slices: (ids, rows, bytes, offsets)."""
    table = table.filter(table.column("joins"))
    data, offsets = blocks.utf8(table.column("text"))
    ids = np.array(table.column("doc_id").to_pylist(), np.int64)
    rows = np.array(table.column("row").to_pylist(), np.int64)
    for lo, hi in blocks.slices(offsets):
        yield ids[lo:hi], rows[lo:hi], data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    n = blocks.parts(blocks.text_bytes(docs, text), 4 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("same", F.sha2("text", 256))
    rows = rows.withColumn("b", F.pmod(F.col("row"), F.lit(n)).cast("int"))
    narrow = rows.where("doc_id is not null").select("same", "doc_id", "row")
    firsts = narrow.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.count("*").alias("n")).where("n > 1")
    copies = stored(narrow.join(firsts.select("same", "f"), "same").where("struct(doc_id, row) <> f").select(
        F.pmod(F.col("row"), F.lit(n)).cast("int").alias("b"), "row").distinct(), "copies")

    def mark(key, table, gone):
        import pyarrow.compute as pc

        lost = pc.is_in(table.column("row"), value_set=gone.column("row").combine_chunks())
        valid = pc.is_valid(table.column("doc_id"))
        # of rows that repeat id and text one takes part
        r = np.array(table.column("row").to_pylist(), np.int64)
        one = np.zeros(len(r), bool)
        one[np.unique(r, return_index=True)[1]] = True
        joins = pc.and_(pc.and_(pc.invert(lost), valid), pa.chunked_array([pa.array(one)]))
        return pa.table({"b": table.column("b"), "row": table.column("row"), "doc_id": table.column("doc_id"), "text": table.column("text"),
                         "joins": joins, "copy": pc.and_(lost, valid)})

    marked = rows.select("b", "row", "doc_id", "text").groupBy("b").cogroup(copies.groupBy("b")).applyInArrow(
        mark, "b int, row long, doc_id long, text string, joins boolean, copy boolean")

    def ask(key, table):
        found = [anchors(d, o)[1] for _, _, d, o in _parts(table)]
        keys = np.concatenate([np.zeros(0, U), *found])
        _, _, distinct, many = _many(keys, np.arange(len(keys)))
        return _deal(key[0].as_py(), n, distinct, many)

    def send(key, table, known):
        twice = _answers(known)[0]
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        texts, b = [], key[0].as_py()
        reach = SPAN - KMER
        for ids, rows_, data, offsets in _parts(table):
            p, h, first, last = anchors(data, offsets)
            hit, _ = _find(twice, h)
            p, h, first, last = p[hit], h[hit], first[hit], last[hit]
            d = np.searchsorted(offsets, p, "right") - 1
            left, right = np.minimum(p - offsets[d], reach), np.minimum(offsets[d + 1] - p, SPAN)
            # only what the windows of this anchor hold
            left, right = np.minimum(left, p - first), np.minimum(right, last + SPAN - p)
            for c, v in zip(cols, (h, ids[d], rows_[d], p - offsets[d], left.astype(np.uint8), right.astype(np.uint8),
                                   (p - last).astype(np.uint8), (p - first).astype(np.uint8))):
                c.append(v)
            texts.append((data, p - left, left + right))
        if not texts:
            return empty
        v = [np.concatenate(c) for c in cols]
        flat = np.concatenate([d[blocks.ranges(s, m)] for d, s, m in texts])
        ends = np.cumsum(np.concatenate([m for _, _, m in texts]))
        bucket = ((v[0] >> U(32)) % U(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, at = np.unique(bucket[order], return_index=True)
        cuts = [order[x:y] for x, y in zip(at, np.append(at[1:], len(order)))]
        sizes = v[4].astype(np.int64) + v[5]
        body = pa.array([flat[blocks.ranges(ends[c] - sizes[c], sizes[c])].tobytes() for c in cuts], pa.binary())
        return pa.table([pa.array(own, pa.int32()), pa.array(np.full(len(own), b), pa.int32()), *(_pack(x, cuts) for x in v), body], names=names)

    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    empty = pa.table({c: pa.array([], pa.int32() if c in ("bucket", "b") else pa.binary()) for c in names})
    twice = marked.groupBy("b").applyInArrow(ask, _BLOCKS).groupBy("bucket").applyInArrow(_resolve, _ANSWERS)
    lost = marked.groupBy("b").cogroup(twice.groupBy("b")).applyInArrow(send, _SEGMENTS).groupBy("bucket").applyInArrow(_sorted_bucket, _LOST)

    def apply(key, table, gone):
        data, offsets = blocks.utf8(table.column("text"))
        index: dict[int, list[int]] = {}
        for i, r in enumerate(table.column("row").to_pylist()):
            index.setdefault(r, []).append(i)
        s, t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, a, e in zip(*(gone.column(c).to_pylist() for c in ("rows", "starts", "ends"))):
            r, a, e = (np.frombuffer(x, np.int64) for x in (r, a, e))
            base = np.array([offsets[index[x][0]] for x in r.tolist()], np.int64)
            s.append(base + a)
            t.append(base + e)
        drop = blocks.covered(len(data), np.concatenate(s), np.concatenate(t))
        whole, rows_ = table.column("copy").to_pylist(), table.column("row").to_pylist()
        for i, r in enumerate(rows_):  # copies, and rows that repeat the first of their id and text
            if whole[i] and offsets[i + 1] - offsets[i] >= SPAN:
                drop[offsets[i]:offsets[i + 1]] = True
            elif index[r][0] != i:
                drop[offsets[i]:offsets[i + 1]] = drop[offsets[index[r][0]]:offsets[index[r][0] + 1]]
        a, _ = blocks.runs(drop, offsets)
        total = np.concatenate(([0], np.cumsum(drop)))
        kept = [data[lo:hi][~drop[lo:hi]].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:])]
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(total[offsets])),
                         "n_spans": pa.array(np.diff(np.searchsorted(a, offsets))),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary())})

    return marked.groupBy("b").cogroup(lost.groupBy("b")).applyInArrow(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
