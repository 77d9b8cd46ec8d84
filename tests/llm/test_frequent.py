"""Very frequent passages and the work per key of the training-data operators, without Spark."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from flowlantern.llm import ctw, suffix_dedup


def _occurrences(rng, kinds, m):
    """m occurrences of one anchor among ``kinds`` surroundings that share beginnings and ends, some cut short."""
    core = rng.integers(97, 123, suffix_dedup.KMER).astype(np.uint8)
    before = rng.integers(97, 99, (kinds, 68)).astype(np.uint8)
    after = rng.integers(97, 99, (kinds, 68)).astype(np.uint8)
    before[1::2, 30:], after[::2, :50] = before[0, 30:], after[0, :50]
    pick = rng.integers(0, kinds, m)
    left = np.where(pick % 3 == 0, 40, 68)
    right = np.where(pick % 5 == 0, 70, 100)
    rows = [np.concatenate((before[k, 68 - a:], core, after[k, :b - 32])) for k, a, b in zip(pick, left, right)]
    low = np.maximum(0, suffix_dedup.SPAN - right)
    return left, right, low, left.copy(), rows


def _starts(left, rows):
    size = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.cumsum(size) - size + left


def test_repeats_of_a_frequent_anchor():
    left, right, low, high, rows = _occurrences(np.random.default_rng(4), 40, 300)
    text, starts = _starts(left, rows)
    m = len(rows)
    hit, s, e = suffix_dedup.repeats(np.full(m, 7, np.uint64), np.arange(m), np.full(m, 500), left, right, low, high, text, starts)
    seen, n = set(), 0
    for i, (a, row) in enumerate(zip(left, rows)):
        again = []
        for j in range(low[i], high[i] + 1):
            window = (j, row[a - j:a - j + 100].tobytes())
            again += [j] if window in seen else []
            seen.add(window)
        n += not again
        assert hit[i] == bool(again) and (not again or (s[i], e[i]) == (500 - max(again), 500 - min(again) + 100))
    assert 0 < n < 41


def test_a_frequent_anchor_takes_little_memory():
    """Before: about 4 KB for each occurrence, so the 250,000 of one passage did not fit an executor."""
    m = 30_000
    left, right, low, high, rows = _occurrences(np.random.default_rng(5), 1000, m)
    text, starts = _starts(left, rows)
    tracemalloc.start()
    suffix_dedup.repeats(np.full(m, 7, np.uint64), np.arange(m), np.full(m, 500), left, right, low, high, text, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1200 * m


def test_words_order_like_bytes():
    rng = np.random.default_rng(6)
    rows = [bytes(rng.integers(0, 2, int(n)).astype(np.uint8)) for n in rng.integers(0, 30, 400)]
    text, size = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows])
    found = suffix_dedup.Suffixes(text, np.cumsum(size) - size, size, 30, 1, 0x9E3779B97F4A7C15)
    order, lcp = found.sort(np.zeros(len(rows), np.int64))
    assert [rows[i] for i in order] == sorted(rows) and found.verified(order, lcp)
    for k in range(1, len(rows)):
        x, y = rows[order[k - 1]], rows[order[k]]
        assert lcp[k] == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert not found.verified(order, lcp + (np.arange(len(lcp)) == 350) * 9)


def test_counts_are_taken_without_the_places_of_keys(monkeypatch):
    """Before: every key of a batch was sorted with its place, twice as long as the rest of the work."""
    texts = ["the Cat sat", "", None, "the cat", "a b a b a b", "x" * 300]
    learn = [True, False, True, True, False, True]
    table = pa.table({"text": pa.array(texts), "learn": pa.array(learn)})
    sizes, inner = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or inner(x, *a, **k))
    asked = list(ctw._asked(table, 5))
    monkeypatch.undo()
    assert sizes == [len(k) for k, _, _ in asked]
    for find, (k, c, cuts), (same, places, _) in zip((ctw.word_keys, ctw.codes), asked, ctw._placed(table, 5)):
        want = Counter()
        for t, taught in zip(texts, learn):
            data = np.frombuffer((t or "").encode(), np.uint8)
            for key in find(data, np.array([0, len(data)]))[0].tolist():
                want[key] += taught
        assert dict(zip(k.tolist(), c.tolist())) == want and k.tolist() == sorted(want) == same.tolist()
        assert {b: x.tolist() for b, x in cuts.items()} == {b: x.tolist() for b, x in places.items()}
        assert sorted(i for x in cuts.values() for i in x.tolist()) == list(range(len(k)))
