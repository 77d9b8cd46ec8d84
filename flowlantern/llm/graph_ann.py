"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt to shards of bounded size by hash. A shard is one task: it links its vectors in rounds that double in size. Greedy beam
searches of the graph so far propose neighbours, relaxed pruning keeps those that no kept, nearer one covers (alpha * d(kept, v) <= d(p, v)
drops v), and links are made mutual and pruned again. Queries search every shard by beam search, and the nearest of all shards win.

Equal vectors would only point at one another, so a shard's graph holds each vector once with the smallest of its ids: of equal vectors
at most ``k + 1`` ids can be among a query's k nearest (one may be the query itself), so larger ids than those cannot appear in any answer.

A shard's graph is built once and stored as one row. Queries are dealt to blocks of bounded size, and each (shard, block) is one group of a
task: it holds one graph and reads its queries in Arrow batches, so neither time nor memory of a task grows with the number of queries.

Vectors are divided by one power of two for the whole table, which changes no digit and no order, so that squares of very large or small
components stay finite. Links are chosen in single precision around a shard's mean; searches and answers are double precision, answers in the
scale of the original vectors; ties go to the smaller id.
A shard of at most ``EXACT`` vectors is compared as a whole, which a graph of that size would do as well.

Defined cases: null ids, and vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of other than
the most common length take no part, since the Euclidean distance is defined for equal lengths only. Rows that repeat an id with different
vectors are all candidates, and the id counts with its nearest; as a query the id asks with the smallest of its vectors. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlantern.llm.graph import stored

SHARD = 8000
BLOCK = 20_000
EXACT = 64
DEGREE = 32
BEAM = 64
QUERY_BEAM = 128
ENTRIES = 32
ALPHA = 1.2
_FOUND = "query_id long, vec_id long, score double"
_PARTS = ("x", "links", "start", "ids", "counts")


def _distances(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[rows[i, j]]."""
    d = x[rows] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _euclidean(d: np.ndarray) -> np.ndarray:
    """Lengths of the rows of d, also where the squares of a row would vanish."""
    out = np.sqrt((d**2).sum(1))
    tiny = out < 1e-140
    if tiny.any():
        most = np.maximum(np.abs(d[tiny]).max(1), np.finfo(float).tiny)
        out[tiny] = most * np.sqrt(((d[tiny] / most[:, None]) ** 2).sum(1))
    return out


def beam_search(x: np.ndarray, links: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest rows found for all queries at once: (rows, squared distances), nearest first; -1 where fewer were reached."""
    n = len(q)
    rows = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, x.dtype)
    done = np.zeros((n, beam), bool)
    m = min(len(start), beam)
    rows[:, :m] = start[:m]
    dist[:, :m] = _distances(x, rows[:, :m], q)
    active = np.arange(n)
    while len(active):
        open_ = np.where((rows[active] >= 0) & ~done[active], dist[active], np.inf)
        best = open_.argmin(1)
        live = np.isfinite(open_[np.arange(len(active)), best])
        active, best = active[live], best[live]
        if not len(active):
            break
        done[active, best] = True
        near = links[rows[active, best]]
        ok = near >= 0
        d = np.where(ok, _distances(x, np.maximum(near, 0), q[active]), np.inf).astype(x.dtype)
        d[(near[:, :, None] == rows[active][:, None, :]).any(2)] = np.inf
        r = np.concatenate((rows[active], near), 1)
        dd = np.concatenate((dist[active], d), 1)
        f = np.concatenate((done[active], np.zeros(near.shape, bool)), 1)
        keep = np.argpartition(dd, beam - 1, 1)[:, :beam]
        i = np.arange(len(active))[:, None]
        rows[active] = np.where(np.isfinite(dd[i, keep]), r[i, keep], -1)
        dist[active], done[active] = dd[i, keep], f[i, keep]
    order = np.argsort(dist, 1, kind="stable")
    i = np.arange(n)[:, None]
    return rows[i, order], dist[i, order]


def pruned(x: np.ndarray, points: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Robust pruning of the candidates of each point (-1: none): at most DEGREE diverse neighbours, nearest first."""
    d = _distances(x, np.maximum(near, 0), x[points])
    d[(near < 0) | (near == points[:, None])] = np.inf
    order = np.argsort(d, 1, kind="stable")
    i = np.arange(len(points))[:, None]
    near, d = near[i, order], d[i, order]
    d[:, 1:][near[:, 1:] == near[:, :-1]] = np.inf
    out = np.full((len(points), DEGREE), -1)
    row = np.arange(len(points))
    for k in range(DEGREE):
        best = d.argmin(1)
        live = np.isfinite(d[row, best])
        if not live.any():
            break
        pick = near[row, best]
        out[live, k] = pick[live]
        covered = ALPHA**2 * _distances(x, np.maximum(near, 0), x[np.maximum(pick, 0)]) <= d
        d[covered & live[:, None]] = np.inf
        d[row[live], best[live]] = np.inf
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (n x DEGREE, -1: none) and the entry points: the vector nearest to the mean, which may lie in a dense cluster that no link
    leaves, and ENTRIES - 1 random ones."""
    n = len(x)
    links = np.full((n, DEGREE), -1)
    middle = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if n else 0
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([middle], order[order != middle])) if n else order
    start = order[:ENTRIES]
    for turn in range(2):  # the second turn links the early ones to what came after them
        at, size = (len(start), len(start)) if turn == 0 else (0, 512)
        while at < n:
            new = order[at:at + min(size, 512)]
            found, _ = beam_search(x, links, start, x[new], BEAM)
            links[new] = pruned(x, new, np.concatenate((found, links[new]), 1))
            src = np.repeat(new, DEGREE)
            dst = links[new].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            heads, first, count = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(heads), DEGREE + int(count.max()) if len(heads) else DEGREE), -1)
            back[:, :DEGREE] = links[heads]
            back[np.repeat(np.arange(len(heads)), count), DEGREE + np.arange(len(dst)) - np.repeat(first, count)] = src
            for lo in range(0, len(heads), 256):
                links[heads[lo:lo + 256]] = pruned(x, heads[lo:lo + 256], back[lo:lo + 256])
            at, size = at + len(new), size * 2
    return links, start


def _scaled(column, e: int, rows: int) -> np.ndarray:
    return np.ldexp(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1), -e)


def _graphs(e: int):
    """One row for a shard: its vectors, links and entry points as bytes, and the ids of each vector."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("ids").to_pylist()
        order = np.argsort([i[0] for i in ids])  # a graph depends on the vectors only, not on their order of arrival
        x = _scaled(table.column("v").combine_chunks(), e, len(ids))[order]
        ids = [ids[i] for i in order]
        middle = x - x.mean(0)  # single precision around the mean does for links
        links, start = build((middle / (np.abs(middle).max() or 1.0)).astype(np.float32)) if len(x) > EXACT else (np.zeros((0, DEGREE), np.int64), np.arange(len(x)))
        counts = np.array([len(i) for i in ids], np.int64)
        parts = (x, links.astype(np.int32), start.astype(np.int64), np.concatenate(ids).astype(np.int64), counts)
        return pa.table({"shard": table.column("shard").slice(0, 1), **{
            n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(_PARTS, parts)}})

    return run


def _nearest(batches: Iterator[pa.RecordBatch], e: int, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, block): the graph first, then its queries, which are searched batch by batch."""
    key = None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in ("shard", "block")], 1)
        heads = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]).any(1) | heads[:-1]
        cuts = np.append(np.flatnonzero(change), len(place))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if heads[lo]:
                raw = {n: batch.column(n)[lo].as_buffer() for n in _PARTS}
                counts = np.frombuffer(raw["counts"], np.int64)
                x = np.frombuffer(raw["x"], np.float64).reshape(len(counts), -1)
                links, start = np.frombuffer(raw["links"], np.int32).reshape(-1, DEGREE), np.frombuffer(raw["start"], np.int64)
                ids, first = np.frombuffer(raw["ids"], np.int64), np.cumsum(counts) - counts
                key = place[lo].tolist()
            elif key == place[lo].tolist():  # a shard without vectors has no graph
                part = batch.slice(lo, hi - lo)
                q = _scaled(part.column("v"), e, len(part))
                names = part.column("vec_id").to_numpy()
                if len(links):
                    found = np.concatenate([beam_search(x, links, start, q[i:i + 256], beam)[0] for i in range(0, len(q), 256)])
                else:
                    found = np.tile(start, (len(q), 1))
                out: list[tuple[int, int, float]] = []
                for name, v, near in zip(names.tolist(), q, found):
                    near = near[near >= 0]
                    d = np.ldexp(_euclidean(x[near] - v), e)
                    best: dict[int, float] = {}
                    for r, score in zip(near.tolist(), d.tolist()):
                        for i in ids[first[r]:first[r] + counts[r]].tolist():
                            if i != name:
                                best[i] = min(score, best.get(i, score))
                    out += [(name, i, score) for i, score in sorted(best.items(), key=lambda b: (b[1], b[0]))[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 10, beam: int = QUERY_BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``queries`` selects, against all other rows."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(
        F.count("*").alias("rows"), F.count_if("asks").alias("asks"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    sizes = sizes.orderBy(F.desc("rows"), "n").first()
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else 0))
    total, asks, e = (sizes["rows"], sizes["asks"], int(np.frexp(sizes["most"])[1])) if sizes else (0, 0, 0)
    # of equal vectors the k + 1 smallest ids, found in two steps so that a very common vector is spread
    same = F.xxhash64("v")
    some = rows.select("vec_id", "v").distinct().withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = some.withColumn("i", F.row_number().over(Window.partitionBy(same, "deal", "v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    some = some.withColumn("i", F.row_number().over(Window.partitionBy(same, "v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    distinct = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    n, blocks = max(1, -(-total // SHARD)), max(1, -(-asks // BLOCK))
    shards = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    graphs = stored(shards.groupBy("shard").applyInArrow(_graphs(e), "shard int, " + ", ".join(f"{c} binary" for c in _PARTS)), "graphs")

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(n))
    work = graphs.withColumn("block", every(blocks)).unionByName(asked, allowMissingColumns=True)
    work = work.repartition(n * blocks, "shard", "block").sortWithinPartitions("shard", "block", F.col("x").isNull())
    found = work.mapInArrow(lambda it: _nearest(it, e, k, beam), _FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
