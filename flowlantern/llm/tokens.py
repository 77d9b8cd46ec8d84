"""Token ids of whole texts. Texts are cut where a byte-level tokenizer's own pattern always cuts (before a single blank between two
visible characters, and between a letter and a sign), each distinct cut is encoded once per worker, and ids are put together again: equal to encoding the whole text."""

from __future__ import annotations

import os

import numpy as np

from flowlantern.llm import blocks

CACHE = 3 << 20  # distinct cuts remembered by a worker
_cut_after = np.zeros(256, bool)
_cut_after[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)}
        self.raw_marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # signs that no contraction and no special token has in it
        self.signs = np.zeros(256, bool)
        self.signs[[c for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" if not any(c in m for m in self.raw_marks)]] = True
        self._clear()

    def _clear(self):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)

    def _new(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct cuts. Many are encoded in one call with a special token between them, at which ids are split."""
        special = next((t for t, i in self.marks.items()), None)
        ids, sizes = [], np.zeros(len(texts), np.int64)
        mark = special.encode() if special else b""
        plain = [i for i, t in enumerate(texts) if special and not any(m in t for m in self.raw_marks)]
        other = sorted(set(range(len(texts))) - set(plain))
        got: list[tuple[int, np.ndarray]] = []
        groups = [plain[k:k + 512] for k in range(0, len(plain), 512)]
        found = self.tokenizer.encode_batch_fast([mark.join(texts[i] for i in g).decode() for g in groups], add_special_tokens=False)
        for g, e in zip(groups, found):
            x = np.array(e.ids, self.ids.dtype)
            at = np.flatnonzero(x == self.marks[special])
            n = np.diff(np.concatenate(([-1], at, [len(x)]))) - 1
            if len(n) != len(g):
                other += g
                continue
            sizes[g] = n
            got.append((g[0], np.delete(x, at)))
        for i in other:
            x = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, self.ids.dtype)
            sizes[i] = len(x)
            got.append((i, x))
        if other:  # put single cuts back in order
            whole = np.zeros(int(sizes.sum()), self.ids.dtype)
            start = np.cumsum(sizes) - sizes
            alone = set(other)
            for g, e in zip(groups, found):
                if g and g[0] not in alone:
                    x = np.array(e.ids, self.ids.dtype)
                    whole[blocks.ranges(start[g], sizes[g])] = x[x != self.marks[special]]
            for i, x in got:
                if i in alone:
                    whole[start[i]:start[i] + len(x)] = x
            return whole, sizes
        return np.concatenate([x for _, x in got]) if got else self.ids[:0], sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32) and their offsets (n + 1)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, bool)
        # a letter of the block of Latin letters with accents (lead byte 0xC3) is visible, too
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # these two are signs
        cut[1:-1] = (data[1:-1] == 0x20) & (_cut_after[data[:-2]] | latin[:-2]) & (_cut_after[data[2:]] | (data[2:] == 0xC3))
        # a letter run always ends before these signs
        cut[1:] |= self.signs[data[1:]] & (_LETTER[data[:-1]] | latin[:-1])
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        distinct, first, back = ranked[fresh], order[fresh], np.empty(len(keys), np.int64)
        back[order] = np.cumsum(fresh) - 1
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            if len(self.keys) > CACHE:
                self._clear()
                known[:], at[:] = False, 0
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            found, sizes = self._new([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            where = at[new]  # both are in order, so nothing is sorted again
            self.keys = np.insert(self.keys, where, distinct[new])
            self.starts = np.insert(self.starts, where, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.uint32))
            self.sizes = np.insert(self.sizes, where, sizes.astype(np.uint32))
            self.ids = np.concatenate([self.ids, found])
            at = np.searchsorted(self.keys, distinct)
        sizes = self.sizes[at].astype(np.int64)[back]
        ids = self.ids[blocks.ranges(self.starts[at].astype(np.int64)[back], sizes)].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, total[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id ``end`` after each text."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    new = at + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new


def batches(column, path: str, end: int):
    """(first row, last row, ids, offsets) for groups of rows of a text column; the end id is appended to each text."""
    data, offsets = blocks.utf8(column)
    enc = encoder(path)
    for lo, hi in blocks.slices(offsets, blocks.FEW_BYTES):
        ids, at = enc.encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, *with_end(ids, at, end)
