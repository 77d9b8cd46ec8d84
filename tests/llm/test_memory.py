"""Memory of a worker: bytes that numpy and Python hold at most while whole texts are hashed, aligned and encoded, and the same results as by brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlantern.llm import blocks, order_minhash as om, tokens

WORDS = np.array([f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(5000)])


def texts(n: int, words: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join(WORDS[rng.integers(0, len(WORDS), words)]) for _ in range(n)]


def peak_mb(run) -> float:
    """Most that ``run`` holds beyond what was held before, the second time."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashes_of_a_batch_hold_little():
    batch = pa.RecordBatch.from_pydict({"text": texts(600, 600)})  # some 3 MB
    assert peak_mb(lambda: [om._node(w) for w in om._hashed(batch, "text")]) < 20


def test_links_of_a_bucket_hold_little():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    seqs = [np.where(rng.random(60) < 0.2, rng.integers(0, 1 << 62, 60).astype(np.uint64), base) for _ in range(2000)]
    assert peak_mb(lambda: om.linked(seqs, np.zeros(2000, np.int64))) < 50  # one matrix of 16 MB, and strips of it


@pytest.mark.parametrize("few", [2, 32])
def test_links_are_those_of_all_pairs(monkeypatch, few):
    monkeypatch.setattr(om, "FEW", few)
    monkeypatch.setattr(om, "STRIP", 7)
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(4)]
    seqs = []
    for i in range(60):
        s = bases[i % 4].copy()
        at = rng.choice(40, int(rng.integers(0, 9)), replace=False)
        s[at] = rng.integers(0, 1 << 62, len(at)).astype(np.uint64)
        seqs.append(np.r_[s, s[:3]] if i % 5 == 0 else s)
    roots = np.arange(60)

    def classes(pairs):
        parent = list(range(60))
        for a, b in pairs:
            a, b = parent[a], parent[b]
            parent = [b if p == a else p for p in parent]
        return {frozenset(i for i in range(60) if parent[i] == p) for p in parent}

    every = [(i, j) for i in range(60) for j in range(i + 1, 60) if om.aligned(seqs[i], seqs[j]) > 0]
    assert 1 < len(classes(every)) < 60
    assert classes(om.linked(seqs, roots)) == classes(every)


@pytest.mark.parametrize("cache", [3 << 20, 500])
def test_ids_are_those_of_whole_texts(monkeypatch, cache):
    """Over many groups of rows, also where the worker forgets its cuts in between."""
    monkeypatch.setattr(tokens, "CACHE", cache)
    monkeypatch.setattr(blocks, "FEW_BYTES", 3000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "_loaded", {})
    docs = [*texts(30, 120), "", None, *texts(5, 1000, seed=4), "a,b  c\n\nd", *texts(30, 120)]
    whole = Tokenizer.from_file(path)
    got = []
    for lo, hi, ids, at in tokens.batches(pa.array(docs), path, 1):
        got += [ids[at[k]:at[k + 1]].tolist() for k in range(hi - lo)]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in docs]
    known = tokens.encoder(path).keys
    assert (known[1:] > known[:-1]).all()


def test_encoding_a_batch_holds_little():
    path = public_tokenizers.path("byte_bpe_50k.json")
    column = pa.array(texts(600, 600))

    def run():
        for _ in tokens.batches(column, path, 1):
            pass

    assert peak_mb(run) < 20
