"""A store of token ids with keyed access.

``write`` makes a table of shards in ascending key order. A shard holds the ids of some thousand documents as one little-endian
payload (16 bits an id where the vocabulary allows it, else 32), and a minimal perfect hash index over its keys: displacement seeds,
and for each slot an 8-byte fingerprint, the place of the document in the payload and its length. A lookup takes one hash, one slot,
one comparison of fingerprints; the keys need not be scanned. ``scan`` and ``lookup`` read the store back.

Defined cases: a null or empty text has only the end id. Rows without a key come first and are stored, but not indexed; of rows with
equal keys a lookup finds the first of each shard, a scan finds all. Empty input makes an empty store. Further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlantern.llm import blocks, tokens
from flowlantern.llm.graph import stored
from flowlantern.session import BROADCAST_ROWS

GROUP = 4096  # parts whose bases are summed by one task
SHARD_IDS = 1 << 20  # a shard is closed when it holds so many ids
_SCHEMA = ("part int, shard int, first_key long, last_key long, ids long, width int, keys binary, seeds binary, "
           "prints binary, starts binary, sizes binary, payload binary")


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return blocks.mix(keys.view(np.uint64) ^ blocks.mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(0x632BE59BD9B4E019)))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a minimal perfect hash over distinct int64 keys, and the slot of each key.

    Keys are dealt to buckets; the largest bucket first, each looks for a seed that sends its keys to free slots. A bucket of one key
    stores its slot directly, as a negative number.
    """
    n = len(keys)
    m = max(1, (n + 3) // 4)
    seeds, slots = np.zeros(m, np.int32), np.zeros(n, np.int64)
    if not n:
        return seeds, slots
    bucket = (_hash(keys, 0) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(m + 1))
    size = np.diff(bounds)
    taken = np.zeros(n, bool)
    free = 0
    for b in np.argsort(-size, kind="stable"):
        own = order[bounds[b]:bounds[b + 1]]
        if len(own) == 0:
            break
        if len(own) == 1:
            while taken[free]:
                free += 1
            taken[free], slots[own[0]], seeds[b] = True, free, -free - 1
            continue
        seed, tries = 1, 16
        while True:  # many seeds at once; as slots fill up, more are needed
            at = (_hash(keys[own], np.arange(seed, seed + tries, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(at, axis=1)
            fits = np.flatnonzero(~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
            if len(fits):
                break
            seed, tries = seed + tries, min(tries * 4, 4096)
        at = at[fits[0]]
        taken[at], slots[own], seeds[b] = True, at, seed + fits[0]
    return seeds, slots


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Constant-time slots; a key that is not in the index gets some slot, which its fingerprint refuses."""
    s = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(s < 0, -s - 1, (_hash(keys, np.maximum(s, 0).astype(np.uint64)) % np.uint64(max(1, n))).astype(np.int64))


def _shard(part: int, number: int, keys: np.ndarray, valid: np.ndarray, ids: list[np.ndarray], sizes: np.ndarray, wide: bool) -> dict:
    ends = np.cumsum(sizes)
    distinct, first = np.unique(keys[valid], return_index=True)
    first = np.flatnonzero(valid)[first]
    seeds, slots = build_index(distinct)
    prints, starts, lengths = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    prints[slots], starts[slots], lengths[slots] = _hash(distinct, 7), (ends - sizes)[first], sizes[first]
    kind = np.uint32 if wide else np.uint16
    return {"part": part, "shard": number, "first_key": int(distinct[0]) if len(distinct) else None,
            "last_key": int(distinct[-1]) if len(distinct) else None, "ids": int(ends[-1]), "width": 4 if wide else 2,
            "keys": np.where(valid, keys, 0).astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + sizes.astype("<i8").tobytes(),
            "seeds": seeds.astype("<i4").tobytes(), "prints": prints.astype("<u8").tobytes(), "starts": starts.astype("<i8").tobytes(),
            "sizes": lengths.astype("<i8").tobytes(), "payload": np.concatenate(ids).astype(kind).tobytes()}


def write(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all texts and writes the store to ``path``; ``tokenizer`` is a vocabulary file of the tokenizers library."""
    total = blocks.text_bytes(docs, text)
    n = blocks.parts(total, 16 << 20)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.select("key", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        wide = tokens.encoder(tokenizer).tokenizer.get_vocab_size() > 65536
        keys, valid, ids, sizes, held, number, part = [], [], [], [], 0, 0, 0
        for batch in batches:
            k = batch.column(0)
            kv, ok = k.fill_null(0).to_numpy(zero_copy_only=False), k.is_valid().to_numpy(zero_copy_only=False)
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for lo, hi, i, at in tokens.batches(batch.column(1), tokenizer, end):
                keys.append(kv[lo:hi])
                valid.append(ok[lo:hi])
                ids.append(i)
                sizes.append(np.diff(at))
                held += len(i)
                if held >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([_shard(part, number, np.concatenate(keys), np.concatenate(valid), ids, np.concatenate(sizes), wide)], schema=schema)
                    keys, valid, ids, sizes, held, number = [], [], [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, number, np.concatenate(keys), np.concatenate(valid), ids, np.concatenate(sizes), wide)], schema=schema)

    b = pa.binary()
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("ids", pa.int64()),
                        ("width", pa.int32()), *((c, b) for c in ("keys", "seeds", "prints", "starts", "sizes", "payload"))])
    rows.mapInArrow(run, _SCHEMA).write.parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``base``, the number of ids before each."""
    all_ = spark.read.schema(_SCHEMA).parquet(path)
    # two levels, so that no window holds all parts: groups of parts, then the parts and shards of a group
    group = F.call_function("div", F.col("part"), F.lit(GROUP)).cast("int")
    ids = all_.select(group.alias("grp"), "part", "shard", "ids")
    groups = ids.groupBy("grp").agg(F.sum("ids").alias("n"))
    before = groups.select("grp", (F.sum("n").over(Window.orderBy("grp")) - F.col("n")).alias("before"))
    inside = ids.withColumn("base", F.sum("ids").over(Window.partitionBy("grp").orderBy("part", "shard")) - F.col("ids"))
    bases = stored(inside.join(before, "grp").select("part", "shard", (F.col("base") + F.col("before")).alias("base")), "bases")
    if bases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return all_.join(bases, ["part", "shard"])


def _rows(row: dict):
    """Keys of a shard in order, which of them are set, and sizes."""
    n = len(row["keys"]) // 17
    k = row["keys"]
    return np.frombuffer(k, "<i8", n), np.frombuffer(k, np.uint8, n, 8 * n).astype(bool), np.frombuffer(k, "<i8", n, 9 * n)


def find(row: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index lookup in one shard: which keys are there, their start in the payload and their number of ids."""
    prints = np.frombuffer(row["prints"], "<u8")
    if not len(prints) or not len(keys):
        z = np.zeros(len(keys), np.int64)
        return z.astype(bool), z, z
    slot = slot_of(keys, np.frombuffer(row["seeds"], "<i4"), len(prints))
    ok = prints[slot] == _hash(keys, 7)
    return ok, np.frombuffer(row["starts"], "<i8")[slot], np.frombuffer(row["sizes"], "<i8")[slot]


def payload(row: dict) -> np.ndarray:
    return np.frombuffer(row["payload"], "<u4" if row["width"] == 4 else "<u2")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document; keyed ones through the index."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, valid, sizes = _rows(row)
                starts = np.cumsum(sizes) - sizes
                fresh = valid.copy()
                fresh[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
                ok, at, n = find(row, keys[fresh])
                if not ok.all():
                    raise ValueError("a stored key is missing from its index")
                starts[fresh], sizes = at, sizes.copy()
                sizes[fresh] = n
                ids = payload(row)
                crc = [zlib.crc32(ids[a:a + m].astype("<u4").tobytes()) for a, m in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=~valid), pa.array(starts + row["base"]), pa.array(sizes),
                                                  pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return shards(spark, path).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, ids (array<int>) for each distinct row of ``keys`` (column key) that is stored; shards are chosen by their key range."""
    all_ = spark.read.schema(_SCHEMA).parquet(path)
    bounds = all_.where("first_key is not null").select("part", "shard", "first_key", "last_key")
    k = keys.select(F.col("key").cast("long").alias("key")).where("key is not null").distinct()
    asked = k.join(bounds, (k.key >= bounds.first_key) & (k.key <= bounds.last_key)).groupBy("part", "shard").agg(F.collect_list("key").alias("asked"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                want = np.array(row["asked"], np.int64)
                ok, at, n = find(row, want)
                ids = payload(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(want[ok]), pa.array([ids[a:a + m].astype(np.int32) for a, m in zip(at[ok], n[ok])], pa.list_(pa.int32()))], names=["key", "ids"])

    return all_.join(asked, ["part", "shard"]).mapInArrow(run, "key long, ids array<int>")
