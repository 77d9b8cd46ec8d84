"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions; each is predicted in the contexts of the last 0 to ``DEPTH`` bytes. A node (context, bits of the byte so
far) has the zeros and ones seen in training. Its Krichevsky-Trofimov estimate is weighted against the product of its children's
weighted probabilities, P_w = (P_e + prod P_w(child)) / 2, over all depths; a text is scored with the weights and counts that
training left. Texts are read in lower case (A-Z), preceded by a byte of their own and closed by an end byte, which is coded, too.

Training counts travel as packed arrays of distinct keys: documents are dealt to batches of bounded size, a batch sends its
(context, byte) codes and words with their training counts to buckets. Codes are dealt by the two last context bytes, so a bucket
has whole subtrees; the tree above them has at most 256 * 255 nodes per level and is the only thing the driver sees. Buckets then answer
each batch with the probability of each of its codes and the count of each of its words, in the order asked; the batch, which has
its texts at hand, finds its keys anew, so that no key travels back. No table grows on one machine.

The base score is add-one over words: sum of log10((c + 1) / (N + V + 1)) over words and one end.

Defined cases: null and empty texts have one token, the end. Nothing to train on leaves all counts 0. Rows without id are scored, and
learnt from like id null, whose checksum is null: never. Repeated rows count as often as they occur. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks
from flowlantern.llm.graph import stored

DEPTH = 6
END, BEFORE = 0xFF, 0xFE  # bytes that no UTF-8 text has
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ASK = "kind int, bucket int, b int, n int, keys binary, counts binary"
_TOP = "last int, node int, zeros double, ones double, weighted double, tokens long, distinct long"
_ANSWER = "b int, kind int, bucket int, n int, values binary"
U = np.uint64
_SMALL = 256
_TABLE = np.array([[math.lgamma(i + 0.5) for i in range(_SMALL)], [math.lgamma(i + 1.0) for i in range(_SMALL)]])


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma(n + 1/2) or log gamma(n + 1) of whole numbers: exact for small ones, Stirling's series above."""
    x = np.maximum(n, _SMALL) + (0.5 if half else 1.0)
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, _TABLE[0 if half else 1][np.minimum(n, _SMALL - 1).astype(np.int64)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros, True) + _lgamma(ones, True) - _lgamma(zeros + ones, False) - 2 * math.lgamma(0.5)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end the last DEPTH bytes before it, latest first, and it: 8 * (DEPTH + 1) bits; offsets of the texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    wide = np.full(len(data) + n * (DEPTH + 1), BEFORE, np.uint8)
    start = offsets[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH
    wide[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = _FOLD[data]
    wide[start + size] = END
    x = wide.astype(U)
    m = len(x) - DEPTH
    c = x[DEPTH:].copy()
    for back in range(1, DEPTH + 1):  # the latest byte is the highest
        c |= x[DEPTH - back:m + DEPTH - back] << U(8 * (DEPTH + 1 - back))
    keep = blocks.ranges(start - DEPTH, size + 1)
    return c[keep], np.concatenate(([0], np.cumsum(size + 1)))


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, weight.astype(np.int64)
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(weight[order].astype(np.int64), first)


def packed(values: np.ndarray) -> bytes:
    """Numbers of one width, compressed plane by plane: high bytes are nearly constant."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys as steps."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, U), dtype=U)


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = blocks.words(data, offsets)
    return blocks.span_hash(blocks.prefix_hash(_FOLD[data]), s, e), first


def _slices(table):
    data, offsets = blocks.utf8(table.column("text"))
    learn = np.array(table.column("learn").to_pylist(), bool)
    for lo, hi in blocks.slices(offsets):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], learn[lo:hi]


class Tree:
    """Nodes of all contexts that end in the same bytes; from codes with their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int):
        """Depths from DEPTH up to ``least``; counts of codes that are only asked for are 0."""
        self.nodes: dict[int, tuple] = {}
        byte = (keys & U(255)).astype(np.int64)
        below = None
        for d in range(DEPTH, least - 1, -1):
            context = keys >> U(8 * (DEPTH + 1 - d))
            node = np.concatenate([(context << U(8)) | ((byte >> (8 - k)) + (1 << k)).astype(U) for k in range(8)])
            bit = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
            c = np.tile(counts, 8)
            order = np.argsort(node)
            v = node[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            ids = v[first]
            ones = np.add.reduceat((c * bit)[order], first)
            zeros = np.add.reduceat((c * (1 - bit))[order], first)
            pe = log_kt(zeros, ones)
            if below is None:
                pw = pe
            else:
                child, childw = below
                up = ((child >> U(16)) << U(8)) | (child & U(255))
                total = np.zeros(len(ids))
                np.add.at(total, np.searchsorted(ids, up), childw)
                pw = np.logaddexp(pe, total) - math.log(2)
            self.nodes[d] = (ids, zeros, ones, pe - math.log(2) - pw if below is not None else np.zeros(len(ids)), pw)
            below = (ids, pw)

    def log10(self, keys: np.ndarray, top) -> np.ndarray:
        """Probability of each code's byte. top(last context byte, node, bit) gives (weight, estimate) at depths 1 and 0."""
        byte = (keys & U(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for k in range(8):
            node, bit = (byte >> (8 - k)) + (1 << k), (byte >> (7 - k)) & 1
            q = None
            for d in sorted(self.nodes, reverse=True):
                ids, zeros, ones, w, _ = self.nodes[d]
                at = np.searchsorted(ids, ((keys >> U(8 * (DEPTH + 1 - d))) << U(8)) | node.astype(U))
                p = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                e = np.exp(w[at])
                q = p if q is None else e * p + (1 - e) * q
            for weight, p in top((keys >> U(8 * DEPTH)).astype(np.int64), node, bit):
                q = weight * p + (1 - weight) * q
            out += np.log10(q)
        return out


def _totals(group):
    n = group.column("n").to_pylist()
    part = [unpacked_keys(x, m) for x, m in zip(group.column("keys").to_pylist(), n)]
    return _counted(np.concatenate(part), np.concatenate([unpacked(x, m, np.int32) for x, m in zip(group.column("counts").to_pylist(), n)])), part


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and how often each occurs. The keys are sorted without their places, several times as fast as with them."""
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[:len(k)])
    return k[first], np.diff(np.append(first, len(k)))


def _cuts(k: np.ndarray, n: int, kind: int) -> dict[int, np.ndarray]:
    """The places of each bucket's keys."""
    bucket = ((k >> U(32) if kind == 0 else blocks.mix(k >> U(8 * (DEPTH - 1)))) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    return dict(zip(own.tolist(), (order[x:y] for x, y in zip(at, np.append(at[1:], len(order))))))


def _asked(table, n: int):
    """For words and for codes of a batch: rising distinct keys, training counts, the places of each bucket's keys."""
    for kind, find in enumerate((word_keys, codes)):
        taught, others = [], [np.zeros(0, U)]
        for _, _, data, offsets, take in _slices(table):
            k, at = find(data, offsets)
            learnt = np.repeat(take, np.diff(at))
            taught.append(_distinct(k[learnt]))
            others.append(_distinct(k[~learnt])[0])
        k, _ = _distinct(np.concatenate([x for x, _ in taught] + others))
        c = np.zeros(len(k), np.int64)
        for own, count in taught:
            c[np.searchsorted(k, own)] += count
        yield k, c, _cuts(k, n, kind)


def _placed(table, n: int):
    """For words and for codes of a batch: rising distinct keys, the places of each bucket's keys, and for each slice of texts
    their offsets, distinct keys and the place of every key among these."""
    for kind, find in enumerate((word_keys, codes)):
        texts = []
        for _, _, data, offsets, _ in _slices(table):
            k, at = find(data, offsets)
            order = np.argsort(k)
            k = k[order]
            new = np.concatenate(([True], k[1:] != k[:-1]))[:len(k)]
            place = np.empty(len(k), np.int32)
            place[order] = np.cumsum(new, dtype=np.int32) - 1
            texts.append((at, k[new], place))
        k, _ = _distinct(np.concatenate([np.zeros(0, U), *(own for _, own, _ in texts)]))
        yield k, _cuts(k, n, kind), texts


def scored(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte of every document."""
    n = blocks.parts(blocks.text_bytes(docs, text), 8 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def ask(key, table):
        out = []
        for kind, (k, c, cuts) in enumerate(_asked(table, n)):
            out.append(pa.table({
                "kind": pa.array([kind] * len(cuts), pa.int32()), "bucket": pa.array(list(cuts), pa.int32()),
                "b": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "n": pa.array([len(x) for x in cuts.values()], pa.int32()),
                "keys": pa.array([packed_keys(k[x]) for x in cuts.values()], pa.binary()),
                "counts": pa.array([packed(c[x].astype(np.int32)) for x in cuts.values()], pa.binary())}))
        return pa.concat_tables(out)

    def top(key, group):
        (keys, counts), _ = _totals(group)
        if key[0].as_py() == 0:
            cols = [[0], [0], [0.0], [0.0], [0.0], [int(counts.sum())], [int((counts > 0).sum())]]
        else:
            ids, zeros, ones, _, pw = Tree(keys, counts, 2).nodes[2]
            up, first = np.unique(((ids >> U(16)) << U(8)) | (ids & U(255)), return_inverse=True)
            add = lambda v: np.bincount(first, v, len(up))
            z = np.zeros(len(up), np.int64)
            cols = [(up >> U(8)).astype(np.int32), (up & U(255)).astype(np.int32), add(zeros), add(ones), add(pw), z, z]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.int64(), pa.int64()))],
                        names=[c.split()[0] for c in _TOP.split(", ")])

    asked = stored(rows.groupBy("b").applyInArrow(ask, _ASK), "counts")
    heads = stored(asked.groupBy("kind", "bucket").applyInArrow(top, _TOP), "heads")
    sums = heads.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    ends = rows.where("learn").count()
    tokens, kinds = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    # the two upper levels: at most 256 * 255 nodes
    upper = heads.where("node > 0").groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).collect()
    one, w1, p1 = np.zeros((256, 256, 2)), np.full((256, 256), 0.5), np.zeros((256, 256))
    for r in upper:
        z, o = np.array([r["zeros"]]), np.array([r["ones"]])
        pe = float(log_kt(z, o)[0])
        pw = np.logaddexp(pe, r["weighted"]) - math.log(2)
        one[r["last"], r["node"]] = r["zeros"], r["ones"]
        w1[r["last"], r["node"]], p1[r["last"], r["node"]] = math.exp(pe - math.log(2) - pw), pw
    zero = one.sum(0)
    pe = log_kt(zero[:, 0], zero[:, 1])
    w0 = np.exp(pe - np.logaddexp(pe, p1.sum(0)))

    def levels(last, node, bit):
        for w, c in ((w1[last, node], one[last, node]), (w0[node], zero[node])):
            yield w, (np.where(bit == 1, c[:, 1], c[:, 0]) + 0.5) / (c.sum(1) + 1)

    def answer(key, group):
        (keys, counts), part = _totals(group)
        kind = key[0].as_py()
        value = counts if kind == 0 else Tree(keys, counts, 2).log10(keys, levels).astype(np.float32)
        return pa.table({"b": group.column("b"), "kind": group.column("kind"), "bucket": group.column("bucket"), "n": group.column("n"),
                         "values": pa.array([packed(value[np.searchsorted(keys, x)]) for x in part], pa.binary())})

    def finish(key, table, known):
        told = {(k, x): (v, m) for k, x, v, m in zip(*(known.column(c).to_pylist() for c in ("kind", "bucket", "values", "n")))}
        look = []
        for kind, (k, cuts, texts) in enumerate(_placed(table, n)):
            v = np.zeros(len(k))
            for x, at in cuts.items():
                v[at] = unpacked(*told[kind, x], (np.int64, np.float32)[kind])
            look.append([(at, v[np.searchsorted(k, own)], place) for at, own, place in texts])
        out = [[] for _ in range(5)]
        less = math.log10(tokens + kinds + 1)
        for (first, known_words, word), (at, known_codes, code) in zip(*look):
            c, lp = known_words[word], known_codes[code]
            total = lambda v, at: np.diff(np.concatenate(([0], np.cumsum(v)))[at])
            m = np.diff(first) + 1
            out[0].append(m)
            out[1].append(total(c > 0, first).astype(np.int64) + (ends > 0))
            out[2].append(total(np.log10(c + 1), first) + math.log10(ends + 1) - m * less)
            out[3].append(np.add.reduceat(lp, at[:-1]))
            out[4].append(np.diff(at) - 1)
        m, known_, base, score, size = (np.concatenate(x) for x in out)
        return pa.table({"doc_id": table.column("doc_id"), "learn": table.column("learn"), "n_tokens": pa.array(m, pa.int64()), "n_known": pa.array(known_, pa.int64()),
                         "train_tokens": pa.array(np.full(len(m), tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
                         "bits_per_byte": pa.array(-score * math.log2(10) / (size + 1))})

    answers = asked.groupBy("kind", "bucket").applyInArrow(answer, _ANSWER)
    return rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(
        finish, "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
