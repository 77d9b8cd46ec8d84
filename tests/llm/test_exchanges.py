"""What the exchanges of op9 leave on disk, and what travels in them."""

import hashlib
import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from flowlantern.llm import debruijn

U = np.uint64
SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_bytes(spark) -> int:
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = (os.path.join(r, f) for d in dirs for r, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data"))
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


def test_exchanges_of_paths_are_freed_before_texts_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 9, 300)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    before, usual = _shuffle_bytes(spark), spark.conf.get(SETTING, "false")
    out = debruijn.deduplicated(docs)
    assert spark.conf.get(SETTING, "false") == usual
    until = time.time() + 10
    while _shuffle_bytes(spark) - before > 100_000 and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_bytes(spark) - before <= 100_000  # the texts alone are about 650,000 bytes
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["n_removed"] == 0 and got[i]["kept_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    assert all(got[200 + i]["n_removed"] == 300 for i in range(20))


def test_marks_come_back_to_the_keys_asked():
    rng = np.random.default_rng(6)
    shared = np.unique(rng.integers(1, 1 << 63, 500).astype(U))
    own = [np.unique(np.concatenate((shared[::2 + b], rng.integers(1, 1 << 63, 900).astype(U)))) for b in range(3)]
    several = [rng.random(len(k)) < 0.1 for k in own]  # keys that two documents of the same batch have
    asked = pa.concat_tables([debruijn._deal(b, 7, k, m, short=True) for b, (k, m) in enumerate(zip(own, several))])
    assert sum(len(x) for x in asked.column("keys").to_pylist()) == 4 * sum(map(len, own))
    answers = pa.concat_tables([debruijn._mark(asked.filter(pa.compute.equal(asked.column("bucket"), x))) for x in range(7)])
    everywhere, times = np.unique(np.concatenate(own), return_counts=True)
    for b, k in enumerate(own):
        mine = answers.filter(pa.compute.equal(answers.column("b"), b))
        marked = debruijn._marked(k, 7, mine.take(rng.permutation(len(mine))))
        want = np.isin(k, everywhere[times > 1])
        for other, m in zip(own, several):
            want |= np.isin(k, other[m])
        assert np.array_equal(marked, k[want])


def test_halves_that_clash_only_mark_more():
    keys = np.array([(1 << 32) + 5, (8 << 32) + 5, (1 << 32) + 6], U)  # the first two share a bucket of 7 and the lower half
    asked = debruijn._deal(0, 7, np.sort(keys), np.zeros(3, bool), short=True)
    assert np.array_equal(debruijn._marked(np.sort(keys), 7, debruijn._mark(asked)), np.sort(keys)[[0, 2]])


def test_shortened_neighbours_still_tell_ends_and_differences():
    keys, ends = np.array([3, 9, 27], U), np.full(3, 2, U)
    words = np.array([0xABCDEF0123456789 | 1, 0xABCDEF0123456789 | 1, 0], U)
    a = debruijn._deal(0, 1, keys, np.zeros(3, bool), words, ends)
    b = debruijn._deal(1, 1, keys, np.zeros(3, bool), words ^ np.array([0, 1 << 40, 0], U), ends)
    out = debruijn._resolve(pa.concat_tables([a, b]))
    assert out.num_rows == 2
    for keys_, flags in zip(out.column("keys").to_pylist(), out.column("flags").to_pylist()):
        assert dict(zip(np.frombuffer(keys_, U).tolist(), flags)) == {3: 0, 9: 1, 27: 1}
