"""Hard negatives by exact integer scores: for an anchor and each of its nearest rows of the same label, the best rows of other labels that score
nearly as high.

Rows and anchors are packed into blocks of bounded bytes; a task owns one (anchor block, candidate block) cell and multiplies tiles of it by
Strassen's recursion: seven products of halves in place of eight, with zero padding of odd sides and int64 additions, down to leaves that are multiplied
directly. Per anchor a cell keeps the heap of its best rows: rows of the anchor's label in the first pass, rows inside the score window of each
positive in the second. Heaps of cells are merged by Spark, which keeps the first rows of each anchor on both sides of the shuffle.

Blocks hold rows of one of ``SHARES`` shares of labels, and a share is cut into as many blocks as its size needs, so that the first pass multiplies
only blocks of the same share and a label with a third of all rows is many blocks.

Sums stay exact: cells whose scores could exceed 2^48 are multiplied as Python integers. A score beyond 64 bits can't be returned and ends the job.
Rows with a null id, label, vector or component, or a component that is not finite, take no part. Vectors of different lengths are compared as
if the shorter ended in zeros. Of rows that share an id the one with the smallest (label, components) counts. Without anchors there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlantern.llm.graph import stored

LEAF = 64            # sides that are multiplied directly
TILE = 1024          # candidates of a tile: a row of scores is sorted by keys of score and place
BLOCK_BYTES = 1 << 20
SHARES = 64
EXACT = 1 << 48      # scores below, times a place of 10 bits, fit in 63 bits


def padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """``a`` with zeros below and to the right."""
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), a.dtype)
    out[:a.shape[0], :a.shape[1]] = a
    return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by Strassen's recursion, exact for integers."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    a, b = padded(a, n + (n & 1), k + (k & 1)), padded(b, k + (k & 1), m + (m & 1))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = multiply(a11 + a22, b11 + b22)
    p2 = multiply(a21 + a22, b11)
    p3 = multiply(a11, b12 - b22)
    p4 = multiply(a22, b21 - b11)
    p5 = multiply(a11 + a12, b22)
    p6 = multiply(a21 - a11, b11 + b12)
    p7 = multiply(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * t), p1.dtype)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.int64).reshape(row["rows"], row["width"])


def _tiles(anchors: dict, rows: dict):
    """(first row, scores of all anchors against a tile of rows); rows come in ascending order of id."""
    a, c = _matrix(anchors), _matrix(rows)
    width = max(a.shape[1], c.shape[1])
    a, c = padded(a, len(a), width), padded(c, len(c), width)
    if width and len(a) and len(c):
        # additions before a product add at most two bits on each side a level
        bound = max(int(a.max()), -int(a.min())) * max(int(c.max()), -int(c.min())) * width
        if bound >= EXACT:
            a, c = a.astype(object), c.astype(object)
    for at in range(0, len(c), TILE):
        tile = c[at:at + TILE]
        yield at, multiply(a, np.ascontiguousarray(tile.T)) if width else np.zeros((len(a), len(tile)), np.int64)


def _ranked(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row in descending order of score, ties in ascending order of place; the allowed ones come first, and their number."""
    n, m = scores.shape
    if scores.dtype == object:
        order = np.array([sorted(range(m), key=lambda j, s=s, ok=ok: (not ok[j], -s[j])) for s, ok in zip(scores, allowed)], np.int64).reshape(n, m)
    else:
        keys = np.where(allowed, -scores * TILE + np.arange(m), np.iinfo(np.int64).max)
        order = np.argsort(keys, axis=1)
    return order, allowed.sum(axis=1)


def _positives(most: int):
    def run(key, table):
        left, right = _sides(table)
        out = []
        if left and right:
            ids, labels = np.frombuffer(right["ids"], np.int64), np.frombuffer(right["labels"], np.int64)
            anchors, of = np.frombuffer(left["ids"], np.int64), np.frombuffer(left["labels"], np.int64)
            for at, scores in _tiles(left, right):
                these, those = ids[at:at + TILE], labels[at:at + TILE]
                order, number = _ranked(scores, (of[:, None] == those) & (anchors[:, None] != these))
                for r in np.flatnonzero(number):
                    for j in order[r, :min(most, number[r])]:
                        out.append((int(anchors[r]), int(these[j]), int(scores[r, j])))
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(most: int, low: int, high: int):
    """Rows of other labels with low * positive <= 100 * score <= high * positive, for every positive of an anchor."""
    def run(key, table):
        left, right = _sides(table)
        out = []
        if left and right:
            ids, labels = np.frombuffer(right["ids"], np.int64), np.frombuffer(right["labels"], np.int64)
            anchors, of = np.frombuffer(left["ids"], np.int64), np.frombuffer(left["labels"], np.int64)
            positives = left["positives"]
            for at, scores in _tiles(left, right):
                these = ids[at:at + TILE]
                order, number = _ranked(scores, of[:, None] != labels[at:at + TILE])
                for r in np.flatnonzero(number):
                    places = order[r, :number[r]]
                    falling = scores[r, places]
                    for positive, score in positives[r]:
                        # -(-x // 100) rounds up: the bounds are whole numbers, so no product overflows
                        top, bottom = high * score // 100, -(-low * score // 100)
                        first = _after(falling, top)
                        for j in places[first:first + most]:
                            s = int(scores[r, j])
                            if s < bottom:
                                break
                            out.append((int(anchors[r]), positive, int(these[j]), score, s))
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _after(falling: np.ndarray, top: int) -> int:
    """Number of leading values above ``top``."""
    lo, hi = 0, len(falling)
    while lo < hi:
        mid = (lo + hi) // 2
        if falling[mid] > top:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _sides(table: pa.Table) -> tuple[dict | None, dict | None]:
    rows = table.to_pylist()
    return next((r for r in rows if r["anchors"]), None), next((r for r in rows if not r["anchors"]), None)


_PACKED = "share int, block int, rows int, width int, ids binary, labels binary, data binary, positives array<array<array<long>>>"


def _pack(key, table):
    """A block of rows, in ascending order of id, as one row of bytes."""
    table = table.sort_by("vec_id")
    vectors = table["parts"].combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    width = int(sizes.max())
    data = np.zeros((len(table), width), np.int64)
    data[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    positives = [table["positives"].to_pylist()] if "positives" in table.schema.names else [None]
    return pa.table({
        "share": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
        "rows": pa.array([len(table)], pa.int32()), "width": pa.array([width], pa.int32()),
        "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()], "labels": [table["label"].to_numpy().astype(np.int64).tobytes()],
        "data": [data.tobytes()], "positives": pa.array(positives, pa.list_(pa.list_(pa.list_(pa.int64()))))})


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of at most about BLOCK_BYTES within each share of labels, packed and stored; and the list of blocks."""
    width = rows.agg(F.max(F.size("parts")).alias("w")).first()["w"] or 1
    each = max(16, BLOCK_BYTES // (8 * width))
    # one row per share, SHARES at most
    sizes = {r["share"]: r["n"] for r in rows.groupBy("share").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, -(-n // each))] or [F.lit(0), F.lit(1)]), F.col("share"))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).groupBy("share", "block").applyInArrow(_pack, _PACKED)
    packed = stored(packed, "blocks")
    return packed, packed.select("share", "block")


def _cells(anchors: DataFrame, candidates: DataFrame, same_share: bool) -> DataFrame:
    """Every anchor block beside every candidate block of its share, or of all shares; as two rows of a group."""
    (left, llist), (right, rlist) = anchors, candidates
    l = llist.select(F.col("share").alias("ls"), F.col("block").alias("lb"))  # noqa: E741
    r = rlist.select(F.col("share").alias("rs"), F.col("block").alias("rb"))
    # names of blocks only: as many pairs as there are products to compute
    pairs = stored(l.join(r, F.col("ls") == F.col("rs")) if same_share else _beside(l, r), "cells")
    a = left.join(pairs, (F.col("share") == F.col("ls")) & (F.col("block") == F.col("lb"))).withColumn("anchors", F.lit(True))
    c = right.join(pairs, (F.col("share") == F.col("rs")) & (F.col("block") == F.col("rb"))).withColumn("anchors", F.lit(False))
    return a.union(c).drop("share", "block")


def _beside(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    """All pairs of blocks, by way of the list of shares."""
    shares = [x["rs"] for x in r.select("rs").distinct().collect()]  # SHARES at most
    return l.withColumn("to", F.explode(F.array(*[F.lit(s) for s in shares]).cast("array<int>"))).join(r, F.col("to") == F.col("rs")).drop("to")


def _best(rows: DataFrame, by: list[str], score: str, ident: str, most: int) -> DataFrame:
    """Merges the heaps of all cells."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ident))).where(F.col("rank") <= most)


def valid_rows(table: DataFrame, vector: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, parts (floor(scale * component)), share; one row per id."""
    x = F.col(vector)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = table.where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("parts"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("r")).select("vec_id", "r.label", "r.parts")
    return rows.withColumn("share", F.pmod(F.xxhash64("label"), F.lit(SHARES)).cast("int"))


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows`` as of :func:`valid_rows`."""
    rows = stored(rows, "vectors")
    anchors = rows.where(anchor)
    candidates = _dealt(rows)
    keys = ["ls", "lb", "rs", "rb"]
    first = _cells(_dealt(anchors), candidates, True).groupBy(*keys).applyInArrow(
        _positives(positives), "anchor_id long, positive_id long, positive_score long")
    found = stored(_best(first, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.array("positive_id", "positive_score")).alias("positives"))
    second = _cells(_dealt(anchors.join(lists, "vec_id")), candidates, False).groupBy(*keys).applyInArrow(
        _negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return _best(second, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS parts
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_sum(list_transform(list_zip(a.parts, c.parts), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
        FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
