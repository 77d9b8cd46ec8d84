"""Near duplicates by order MinHash.

A text is its sequence of five-word shingles, each labelled with how often it occurred before. A sketch takes the ``PICKED`` smallest
labelled shingles under one of ``SKETCHES`` permutations and keeps them in text order, so it changes with content and with order.
Texts that agree in any sketch are candidates. Two texts are linked if a banded alignment of their shingle sequences finds
L common shingles in order with L / (n_a + n_b - L) >= 0.8: the Jaccard similarity, counted in order. Classes are connected components.

With three shingles out of sixteen permutations a pair at exactly 0.8 is missed with probability (1 - 0.8^3)^16 < 1.1e-5.

Texts with the same words are one node, so exact copies never meet as pairs. Within a bucket, every text is first aligned to the one
that shares most buckets with others; what then still lies in different classes of a bucket is aligned pair by pair, so no link is lost.

Defined cases: a text of one to four words is one shingle; null texts and texts without words are classes by themselves, as are
rows without an id. Rows with equal ids and different words put their classes together. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks
from flowlantern.llm.graph import components, stored

SHINGLE = 5
SKETCHES = 16
PICKED = 3
SIMILARITY = 0.8
_SEEDS = blocks.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    n = len(word_hashes)
    k = min(SHINGLE, n)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        out = blocks.mix(out * blocks.BASE + word_hashes[i:n - k + 1 + i])
    return out


def sketch(sh: np.ndarray) -> np.ndarray:
    """SKETCHES 64-bit values of a shingle sequence."""
    marked = labelled(sh)
    k = min(PICKED, len(sh))
    out = np.zeros(SKETCHES, np.uint64)
    for t in range(SKETCHES):
        v = (marked ^ _SEEDS[t]) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        at = np.argpartition(v, k - 1)[:k] if k < len(v) else np.arange(len(v))
        at.sort()  # text order
        h = np.uint64(t + 1)
        for x in marked[at]:
            h = np.uint64((int(h) * int(blocks.BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[t] = h
    return blocks.mix(out)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n_a + n_b - L) for the longest common subsequence L inside the band that ``least`` allows; 0 where it is not reached.

    A pair of that similarity has at most (n_a + n_b) (1 - least) / (1 + least) unmatched shingles, which bounds the band. Rows of the
    alignment matrix are bit vectors.
    """
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    most = int(np.minimum(ca[ia], cb[ib]).sum())
    if most < least * (na + nb - most):
        return 0.0
    same = a[:min(na, nb)] == b[:min(na, nb)]
    head = len(same) if same.all() else int(same.argmin())
    same = a[head:][::-1][:min(na, nb) - head] == b[head:][::-1][:min(na, nb) - head]
    tail = len(same) if same.all() else int(same.argmin()) if len(same) else 0
    x, y = a[head:na - tail].tolist(), b[head:nb - tail].tolist()
    common = head + tail
    if x and y:
        band = int((na + nb) * (1 - least) / (1 + least)) + 1
        at: dict[int, int] = {}
        for i, v in enumerate(x):
            at[v] = at.get(v, 0) | 1 << i
        full = (1 << len(x)) - 1
        row, width = full, (1 << 2 * band + 1) - 1
        for j, v in enumerate(y):
            m = at.get(v)
            if m:
                near = width << j - band if j >= band else width >> band - j
                u = row & m & near
                row = (row + u | row - u) & full
        common += len(x) - row.bit_count()
    s = common / (na + nb - common)
    return s if s >= least else 0.0


BLOCK = 1000
FEW = 32
STRIP = 256  # rows of the matrix of common shingles that are counted at once


def labelled(sh: np.ndarray) -> np.ndarray:
    """Shingles made distinct by how often they occurred before, so that sets of them intersect like multisets."""
    order = np.argsort(sh, kind="stable")
    ranked = sh[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    occ = np.arange(len(sh)) - np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    out = np.empty_like(sh)
    out[order] = blocks.mix(ranked + occ.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return out


def linked(seqs: list[np.ndarray], roots: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Index pairs of similar sequences that connect different roots. Common shingles are counted for all pairs at once; only pairs whose count allows the similarity are aligned."""
    n = np.array([len(x) for x in seqs])
    owner = np.repeat(np.arange(len(seqs)), n)
    ids, inv, count = np.unique(np.concatenate([labelled(x) for x in seqs]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[inv] > 1
    col, row = shared[inv[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    degree = count[inv][keep][order]
    common = np.zeros((len(seqs), len(seqs)), np.float32)
    rare = degree < FEW  # pairs of owners, counted one by one
    c, r = col[rare], row[rare]
    for k in range(1, FEW):
        at = np.flatnonzero(c[k:] == c[:-k]) if k < len(c) else np.zeros(0, np.int64)
        if not len(at):
            break
        np.add.at(common, (r[at], r[at + k]), 1)
    often, c = np.unique(col[~rare], return_inverse=True)  # at most one in FEW of all entries: products of dense blocks
    r = row[~rare]
    for lo in range(0, len(often), 1024):
        here = (c >= lo) & (c < lo + 1024)
        x = np.zeros((len(seqs), min(1024, len(often) - lo)), np.float32)
        x[r[here], c[here] - lo] = 1
        for i in range(0, len(seqs), STRIP):  # only pairs (i, j > i) are read
            common[i:i + STRIP, i:] += x[i:i + STRIP] @ x[i:].T
    # a pair that is connected already adds nothing to the classes
    parent = list(range(int(roots.max()) + 1))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(seqs)):
        both = common[i, i + 1:]
        may = (both >= least * (n[i] + n[i + 1:] - both) - 1e-3) & (roots[i] != roots[i + 1:])
        for j in np.flatnonzero(may).tolist():
            a, b = top(int(roots[i])), top(int(roots[i + 1 + j]))
            if a != b and aligned(seqs[i], seqs[i + 1 + j], least) > 0:
                parent[a] = b
                out.append((i, i + 1 + j))
    return out




def _aligned_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different roots of a bucket. A large bucket is dealt to blocks, and each pair of blocks is one group, so a
    group never exceeds two blocks; only links leave it."""
    size = members.groupBy("band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("deal"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    rows = (members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)).cast("int"))
            .join(size.select("band", "value", "deal", salts), ["band", "value", "salt"])
            .withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deal")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
            .select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")
            .join(texts, "node"))

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        roots = np.unique(np.array([r.hex() for r in group.column("root").to_pylist()]), return_inverse=True)[1]
        seqs = [shingles(w) for batch in group.select(["text"]).combine_chunks().to_batches() for w in _hashed(batch, "text")]
        found = linked(seqs, roots)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return rows.groupBy("band", "value", "i", "j").applyInArrow(run, "a binary, b binary")


_NODES = "doc_id long, node binary, sketch array<long>"


def _hashed(batch, text: str):
    """Per row the hashes of its words."""
    data, offsets = blocks.utf8(batch.column(batch.schema.get_field_index(text)))
    for lo, hi in blocks.slices(offsets, blocks.FEW_BYTES):
        at = offsets[lo:hi + 1] - offsets[lo]
        part = data[offsets[lo]:offsets[hi]]
        s, e, first = blocks.words(part, at)
        w = blocks.span_hash(blocks.prefix_hash(part), s, e)
        for i in range(hi - lo):
            yield w[first[i]:first[i + 1]]


def _node(w: np.ndarray) -> bytes | None:
    """128 bits of the word sequence."""
    if not len(w):
        return None
    p = blocks.powers(len(w))[0]
    with np.errstate(over="ignore"):
        a = blocks.mix(np.array([(w * p).sum() + np.uint64(len(w))], np.uint64))
        b = blocks.mix(np.array([(blocks.mix(w ^ blocks.BASE) * p).sum()], np.uint64))
    return a.tobytes() + b.tobytes()


def sketches(docs: DataFrame, text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, node (128 bits of the words; null without words), sketch, and ``more`` string columns as they are."""
    def run(batches):
        for batch in blocks.freed(batches):
            nodes, values = [], []
            for w in _hashed(batch, text):
                nodes.append(_node(w))
                values.append(sketch(shingles(w)).view(np.int64) if len(w) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(values, pa.list_(pa.int64())), *(batch.column(batch.schema.get_field_index(c)) for c in more)],
                names=["doc_id", "node", "sketch", *more])

    return docs.select("doc_id", text, *more).mapInArrow(run, ", ".join([_NODES, *(f"{c} string" for c in more)]))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """node, doc_id, text."""
    def run(batches):
        for batch in blocks.freed(batches):
            nodes = [_node(w) for w in _hashed(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                 batch.column(batch.schema.get_field_index(text)).cast(pa.string())], names=["node", "doc_id", "text"])

    return docs.select("doc_id", text).mapInArrow(run, "node binary, doc_id long, text string")


def _aligned_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the pairs, after alignment. A hub's text is repeated for each 500 of its pairs, so they spread over tasks."""
    degree = pairs.groupBy("b").agg((F.count("*") / 500).cast("int").alias("last"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).join(degree, "b").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    left = (pairs.join(degree, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("last") + 1).cast("int")).drop("last")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))

    def run(batches):
        for batch in blocks.freed(batches):
            ok = pa.array([aligned(shingles(x), shingles(y)) > 0 for x, y in zip(_hashed(batch, "ta"), _hashed(batch, "tb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    return left.join(right, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _roots(docs: DataFrame, rows: DataFrame, text: str, tie: bool) -> DataFrame:
    """(node, root) of the linked nodes of ``rows``, the sketches of ``docs``; ``tie`` links what rows of one id say, too."""
    spark = docs.sparkSession
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.any_value("sketch").alias("sketch"))
    spread = nodes.select("node", "first", F.posexplode("sketch").alias("band", "value"))
    shared = spread.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    # many texts may share a bucket: its rows are dealt over eight salted keys
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    mates = stored(spread.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)).cast("int"))
                   .join(shared.select("band", "value", "n", salts), ["band", "value", "salt"]), "mates")
    hubs = mates.groupBy("node").agg(F.sum("n").alias("hub"))
    ranked = mates.join(hubs, "node")
    center = ranked.groupBy("band", "value").agg(F.max(F.struct("hub", "node"))["node"].alias("b"))
    pairs = stored(mates.join(center.select("band", "value", "b", salts), ["band", "value", "salt"])
                   .where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")

    needed = mates.groupBy("node").agg(F.min("first").alias("doc_id"))
    texts = stored(_texts(docs, text).join(needed, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    links = stored(_aligned_pairs(pairs, texts), "links")

    roots = components(spark, links)
    # what still lies in different classes of one bucket is compared within it
    placed = mates.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("band", "value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = placed.join(split.select("band", "value", salts), ["band", "value", "salt"]).select("band", "value", "node", "root")
    more = stored(_aligned_blocks(open_, texts), "more")
    if not tie:
        return components(spark, stored(links.union(more), "links"))
    # an id whose rows have different words ties these together
    ids = rows.where("node is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    tied = rows.join(ids.select("doc_id", F.col("a")), "doc_id").where("node is not null").select("a", F.col("node").alias("b"))
    return components(spark, stored(links.union(more).union(tied), "links"))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, class_id for every row: class_id is the smallest doc_id of its class (null for rows without id)."""
    rows = stored(sketches(docs, text), "sketches")
    final = _roots(docs, rows, text, tie=True)
    named = rows.where("node is not null and doc_id is not null").select("node", "doc_id").join(final, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_node = named.select("node", "root").distinct().join(ids, "root").select("node", "class_id")
    big = rows.select("doc_id", "node").join(by_node, "node", "left")
    return big.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def first_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose own text is linked to an earlier one: of each class the row of smallest id, then digest, once.

    Rows of one id with different texts are rows of their own. Rows without id or without words all stay.
    """
    keyed = docs.withColumn("__digest", F.sha2(F.col(text), 256))
    rows = stored(sketches(keyed, text, ("__digest",)), "sketches")
    final = _roots(docs, rows, text, tie=False)
    named = stored(rows.where("node is not null and doc_id is not null").select("doc_id", "__digest", "node").join(final, "node", "left")
                   .select("doc_id", "__digest", F.coalesce("root", "node").alias("root")).groupBy("doc_id", "__digest", "root")
                   .agg(F.count("*").alias("n")), "named")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "__digest")).alias("keep"))
    later = named.join(first, "root").where("struct(doc_id, __digest) <> keep").select("doc_id", "__digest")
    kept = keyed.join(later, ["doc_id", "__digest"], "left_anti")
    if named.where("n > 1").limit(1).count():
        one = F.coalesce(F.col("doc_id").isNotNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.where(one).dropDuplicates(["doc_id", "__digest"]).unionByName(kept.where(~one))
    return kept.select(docs.columns)
