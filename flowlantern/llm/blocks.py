"""Whole texts as byte arrays: Arrow columns are read in place, so that hashing and windowing run over many documents at once.

Everything works on the UTF-8 bytes of a group of texts and the offsets between them; a null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 2 << 20  # texts are handled in groups of about this size; a longer text is a group by itself
FEW_BYTES = 512 << 10  # where hashes or ids of every byte are held, some eighty bytes for each


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow has no more use for goes back to the system after each, as a worker outlives its task and shares the executor's memory."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def slices(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that linear hashes become evenly spread."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INV)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P[i] = sum of (values[j] + 1) * BASE^j over j < i, modulo 2^64."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]: independent of the place, finalised with the length."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than blank and 0x09-0x0D), and the index of the first word of each text (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    out[0] = s[0]
    out[np.cumsum(n)[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of true flags that do not cross the given positions."""
    cut = np.zeros(len(flags) + 1, bool)
    cut[breaks[breaks <= len(flags)]] = True
    start, end = flags.copy(), flags.copy()
    start[1:] &= ~flags[:-1] | cut[1:-1]
    end[:-1] &= ~flags[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of positions inside any of the intervals."""
    d = np.zeros(length + 1, np.int64)
    np.add.at(d, starts, 1)
    np.subtract.at(d, ends, 1)
    return np.cumsum(d)[:length] > 0


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one cheap aggregate that sizes the partitions of a job to its input."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts(total_bytes: int, each: int = 8 << 20, least: int = 8) -> int:
    return max(least, -(-total_bytes // each))


def batch_of(n: int, *columns: str) -> Column:
    """Deals rows to n batches by the hash of the given columns."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(n)).cast("int")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows: whole texts are wide."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
