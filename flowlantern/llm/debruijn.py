"""Substring deduplication over a compacted de Bruijn graph of words.

An edge is a window of ``WINDOW`` consecutive words of one document, its ends are the windows' shorter neighbours. Edges that occur in two
or more documents make the repeated graph. An edge starts a new path where the word before it differs between its occurrences, and ends
one where the word after it does; between such places paths do not branch, so each document holds them whole, and all edges of a path have
the same documents. Occurrences of paths (digest of the words, document, first word) meet in Spark joins: the first document of each
path keeps it, all others lose the words it covers.

Finding the repeated edges without a row per word: documents are dealt to batches of bounded size. In a first exchange a batch asks, for
one in about four word 7-grams (minimizers: any two equal windows share one), whether another document has it. In a second it asks for the
windows around those. Keys of a batch are distinct and travel as packed arrays, so a frequent passage is one key per batch. The first
exchange sends half of each hash and is answered by one bit a key: a word 7-gram taken for another only asks for more windows. Files of
these exchanges are freed as soon as the paths are stored, before the rest of the job writes its own.

Defined cases: null and empty texts have no words; texts shorter than a window lose none. Rows without id neither give nor lose words.
Rows with equal ids are the same document. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks
from flowlantern.llm.graph import stored

WINDOW = 13
KMER = 7
SALTS = 64
_SHORT = "bucket int, b int, keys binary, many binary"
_MARKS = "b int, bucket int, marks binary"
_BLOCKS = "bucket int, b int, keys binary, before binary, after binary, many binary"
_ANSWERS = "b int, keys binary, flags binary"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
NEAR = 6  # bytes of the hash of a neighbouring word that travel
U = np.uint64


def _combined(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values."""
    out = np.zeros(max(0, len(w) - n + 1), U)
    for i in range(n):
        out = blocks.mix(out * blocks.BASE + w[i:len(w) - n + 1 + i]) if i % 4 == 3 or i == n - 1 else (out * blocks.BASE) ^ w[i:len(w) - n + 1 + i]
    return out


class Batch:
    """Words of a group of documents: hashes, windows that stay inside a document, and the document of each."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        self.data, self.offsets = blocks.utf8(table.column("text"))
        self.starts, self.ends, self.first = blocks.words(self.data, self.offsets)
        self.w = blocks.span_hash(blocks.prefix_hash(self.data), self.starts, self.ends)
        n = len(self.w)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.docs = doc
        m = max(0, n - WINDOW + 1)
        keyed = np.array([i is not None for i in self.ids], bool)
        self.inside = (doc[:m] == doc[WINDOW - 1:]) & keyed[doc[:m]] if m else np.zeros(0, bool)
        # the same id in several rows is one document
        self.number = np.unique(np.array([-1 if i is None else i for i in self.ids], np.int64), return_inverse=True)[1] if self.ids else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the smallest word 7-gram of each window (0 where there is no window), and all windows' flags."""
        if not len(self.inside):
            return np.zeros(0, U), self.inside
        h = _combined(self.w, KMER)
        m = len(self.inside)
        low = h[:m].copy()
        for i in range(1, WINDOW - KMER + 1):
            np.minimum(low, h[i:m + i], out=low)
        return low, self.inside

    def edges(self) -> np.ndarray:
        return _combined(self.w, WINDOW)


def _many(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, start of each distinct key, the keys, and whether a key has several documents."""
    order = np.argsort(keys)
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        return order, first, k, np.zeros(0, bool)
    return order, first, k[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


def _one(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value that all occurrences of a key share; 0 where they differ."""
    lo, hi = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(lo == hi, lo, U(0))


def _cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that occur, by the upper half of a key, and the places of each one's keys."""
    bucket = ((keys >> U(32)) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    return own, [order[x:y] for x, y in zip(at, np.append(at[1:], len(order)))]


def _deal(b: int, n: int, keys: np.ndarray, many: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None,
          short: bool = False) -> pa.Table:
    """One row for each bucket of the distinct keys of a batch; ``short``: only the lower half of the keys, without neighbours."""
    own, cuts = _cuts(keys, n)
    pack = lambda a: pa.array([np.ascontiguousarray(a[c]).tobytes() for c in cuts], pa.binary())
    head = {"bucket": pa.array(own, pa.int32()), "b": pa.array(np.full(len(own), b), pa.int32())}
    if short:
        return pa.table({**head, "keys": pack(keys.astype(np.uint32)), "many": pack(many.astype(np.uint8))})
    near = lambda a: pack(a.view(np.uint8).reshape(-1, 8)[:, :NEAR]) if a is not None else pa.nulls(len(cuts), pa.binary())
    return pa.table({**head, "keys": pack(keys), "before": near(before), "after": near(after), "many": pack(many.astype(np.uint8))})


def _near(group: pa.Table, name: str) -> np.ndarray:
    """The neighbours' hashes of all rows of a bucket, shortened."""
    part = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column(name).to_pylist()]).reshape(-1, NEAR)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :NEAR] = part
    return out.view(U).ravel()


def _shared(keys: np.ndarray, group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, start of each distinct key, its rows, and whether several documents have it."""
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("many").to_pylist()])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    count = np.diff(np.append(first, len(k)))
    return order, first, count, (count > 1) | (np.maximum.reduceat(many[order], first) > 0)


def _mark(group: pa.Table) -> pa.Table:
    """For each row a bit per key, in the order asked: whether several documents have it."""
    part = [np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]
    order, _, count, repeated = _shared(np.concatenate(part), group)
    marks = np.zeros(len(order), bool)
    marks[order] = np.repeat(repeated, count)
    ends = np.cumsum([len(x) for x in part])
    return pa.table({"b": group.column("b"), "bucket": group.column("bucket"),
                     "marks": pa.array([np.packbits(marks[e - len(x):e]).tobytes() for x, e in zip(part, ends)], pa.binary())})


def _marked(keys: np.ndarray, n: int, table: pa.Table) -> np.ndarray:
    """The distinct keys that the answers to a batch mark; ``keys`` as they were asked."""
    marks = dict(zip(table.column("bucket").to_pylist(), table.column("marks").to_pylist()))
    hit = np.zeros(len(keys), bool)
    for bucket, at in zip(*_cuts(keys, n)):
        hit[at] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=len(at)).astype(bool)
    return keys[hit]


def _resolve(group: pa.Table) -> pa.Table:
    """Which keys several documents have; flag bit 0: the word before differs, bit 1: the word after does."""
    who = group.column("b").to_pylist()
    part = [np.frombuffer(x, U) for x in group.column("keys").to_pylist()]
    keys, b = np.concatenate(part), np.repeat(np.array(who), [len(x) for x in part])
    order, first, count, repeated = _shared(keys, group)
    k = keys[order]
    flags = np.zeros(len(first), np.uint8)
    for bit, name in ((1, "before"), (2, "after")) if group.column("before")[0].is_valid else ():
        flags |= np.where(_one(_near(group, name)[order], first) == 0, bit, 0).astype(np.uint8)
    keep = np.repeat(repeated, count)
    back = np.repeat(flags, count)[keep]
    k, b = k[keep], b[order][keep]
    order = np.argsort(b, kind="stable")
    own, at = np.unique(b[order], return_index=True)
    cuts = [order[x:y] for x, y in zip(at, np.append(at[1:], len(order)))]
    return pa.table({"b": pa.array(own, pa.int32()), "keys": pa.array([k[c].tobytes() for c in cuts], pa.binary()),
                     "flags": pa.array([back[c].tobytes() for c in cuts], pa.binary())})


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in table.column("keys").to_pylist())])
    flags = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist())])
    order = np.argsort(keys)
    return keys[order], flags[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def paths(docs: DataFrame, n: int) -> DataFrame:
    """(b, row, doc_id, start, edges, digest) of every occurrence of a path; docs: b, row, doc_id, text."""
    def ask_anchors(key, table):
        x = Batch(table)
        low, inside = x.anchors()
        doc = x.number[x.docs[:len(low)]][inside]
        _, _, keys, many = _many(low[inside], doc)
        return _deal(key[0].as_py(), n, keys, many, short=True)

    def ask_edges(key, table, known):
        x = Batch(table)
        low, inside = x.anchors()
        hit, _ = _find(_marked(np.unique(low[inside]), n, known), low)
        at = np.flatnonzero(hit & inside)
        e = x.edges()[at] if len(at) else np.zeros(0, U)
        # the words around a window; the ends of a text are values of their own
        w, same = x.w, x.docs
        prev = np.where((at > 0) & (same[np.maximum(at - 1, 0)] == same[at]), w[np.maximum(at - 1, 0)] | U(1), U(2)) if len(at) else e
        nxt = np.minimum(at + WINDOW, len(w) - 1)
        follow = np.where((at + WINDOW < len(w)) & (same[nxt] == same[at]), w[nxt] | U(1), U(2)) if len(at) else e
        order, first, keys, many = _many(e, x.number[x.docs[at]])
        if not len(keys):
            return _deal(key[0].as_py(), n, keys, many, keys, keys)
        return _deal(key[0].as_py(), n, keys, many, _one(prev[order], first), _one(follow[order], first))

    def cut(key, table, known):
        x = Batch(table)
        keys, flags = _answers(known)
        e = x.edges() if len(x.inside) else np.zeros(0, U)
        hit, at = _find(keys, e)
        hit &= x.inside
        f = np.where(hit, flags[at], 0) if len(keys) else np.zeros(len(e), np.uint8)
        breaks = np.concatenate((x.first, np.flatnonzero(f & 1), np.flatnonzero(f & 2) + 1))
        s, t = blocks.runs(hit, np.unique(breaks))
        raw = x.data.tobytes()
        rows = table.column("row").to_pylist()
        b, d = key[0].as_py(), x.docs[s].tolist()
        digest = [hashlib.blake2b(b" ".join(raw[x.starts[i]:x.ends[j + WINDOW - 2]].split()), digest_size=16).digest() for i, j in zip(s.tolist(), t.tolist())]
        return pa.table({"b": pa.array([b] * len(s), pa.int32()), "row": pa.array([rows[i] for i in d], pa.int64()),
                         "doc_id": pa.array([x.ids[i] for i in d], pa.int64()), "start": pa.array(s - x.first[d] if len(s) else s, pa.int64()),
                         "edges": pa.array(t - s, pa.int64()), "digest": pa.array(digest, pa.binary())})

    by = docs.groupBy("b")
    anchors = by.applyInArrow(ask_anchors, _SHORT).groupBy("bucket").applyInArrow(_mark, _MARKS)
    edges = by.cogroup(anchors.groupBy("b")).applyInArrow(ask_edges, _BLOCKS).groupBy("bucket").applyInArrow(_resolve, _ANSWERS)
    return docs.groupBy("b").cogroup(edges.groupBy("b")).applyInArrow(cut, "b int, row long, doc_id long, start long, edges long, digest binary")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by blanks)."""
    n = blocks.parts(blocks.text_bytes(docs, text), 4 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = rows.withColumn("b", F.pmod(F.col("row"), F.lit(n)).cast("int"))
    # the exchanges of the paths are not read again: their files go before the texts are dealt a second time
    spark = docs.sparkSession
    usual = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        found = stored(paths(rows, n), "paths")
    finally:
        spark.conf.set(_FREED, usual)
    # a frequent path is joined in SALTS parts: the small side has one row for each part of a digest that occurs
    found = found.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    first = found.groupBy("digest", "salt").agg(F.min("doc_id").alias("first")).groupBy("digest").agg(
        F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    first = first.select("digest", "first", F.explode("salts").alias("salt"))
    lost = found.join(first, ["digest", "salt"]).where("doc_id > first").select("b", "row", "start", "edges").distinct()

    def apply(key, table, gone):
        x = Batch(table)
        index: dict[int, list[int]] = {}
        for i, r in enumerate(table.column("row").to_pylist()):
            index.setdefault(r, []).append(i)
        s, t = [], []
        for r, a, m in zip(*(gone.column(c).to_pylist() for c in ("row", "start", "edges"))):
            for i in index.get(r, ()):
                s.append(x.first[i] + a)
                t.append(x.first[i] + a + m + WINDOW - 1)
        drop = blocks.covered(len(x.w), np.array(s, np.int64), np.array(t, np.int64))
        raw = x.data.tobytes()
        kept = []
        for i in range(len(x.ids)):
            lo, hi = x.first[i], x.first[i + 1]
            if drop[lo:hi].any():
                k = lo + np.flatnonzero(~drop[lo:hi])
                kept.append(b" ".join(raw[a:b] for a, b in zip(x.starts[k].tolist(), x.ends[k].tolist())))
            else:
                kept.append(_joined(raw, x, lo, hi))
        total = np.concatenate(([0], np.cumsum(drop)))
        return pa.table({"doc_id": pa.array(x.ids, pa.int64()), "n_words": pa.array(np.diff(x.first), pa.int64()),
                         "n_removed": pa.array(total[x.first[1:]] - total[x.first[:-1]], pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return rows.groupBy("b").cogroup(lost.groupBy("b")).applyInArrow(
        apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _joined(raw: bytes, x: Batch, lo: int, hi: int) -> bytes:
    """All words of a document; bytes.split() cuts at exactly the bytes between words."""
    return b" ".join(raw[x.starts[lo]:x.ends[hi - 1]].split()) if hi > lo else b""
