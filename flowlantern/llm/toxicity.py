"""Toxicity by compression distance.

Two zstandard dictionaries hold toxic and ordinary vocabulary. A text is cut into windows of a few words; each window is
compressed with either dictionary, and a window that shrinks far more with the toxic one is evidence. Counts of windows above
several gains, relative to the text's size, are turned into a score by a logistic curve whose cut is calibrated on the labels.

The dictionaries are raw content: in windows of some thirty bytes the entropy tables of a finalised dictionary cost more than the
vocabulary saves. Both end in a marker, with which every window starts, so that all windows pay for the first match alike.

Defined cases: a null, empty or blank text has no window and gets score 0; labels that are null, or belong to no document, teach
nothing; with one class only every score is 0. Repeated rows are scored alike. Further columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlantern.llm import blocks

MARKER = bytes(range(1, 9)) + bytes((14, 15, 16, 17))
WINDOW_WORDS = 4
GAINS = (2, 3, 4, 5, 6, 8, 10)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled texts of each class that are brought to the driver to train on, ``sample_text`` the bytes
    of one of them; the sample is the rows of smallest hash, whatever the size of the corpus. Everything else covers all rows."""

    sample_rows: int = 3000
    sample_text: int = 16384
    dictionary_bytes: int = 4096
    level: int = 3
    cut: float = 0.7


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    frame: int = 0
    level: int = 3


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased windows of WINDOW_WORDS words with the marker before them, and the first window of each text (n + 1)."""
    starts, ends, first = blocks.words(data, offsets)
    n = np.diff(first)
    per = -(-n // WINDOW_WORDS)
    at = np.concatenate(([0], np.cumsum(per)))
    head = np.repeat(first[:-1], per) + (np.arange(at[-1]) - np.repeat(at[:-1], per)) * WINDOW_WORDS
    tail = np.minimum(head + WINDOW_WORDS, np.repeat(first[1:], per)) - 1
    raw = data.tobytes().lower()
    out = [MARKER + b" " + b" ".join(raw[a:b].split()) + b" " for a, b in zip(starts[head].tolist(), ends[tail].tolist())]
    return out, at


def _compressor(content: bytes, level: int) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content + b" " + MARKER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(c: zstd.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    out = np.empty(len(windows), np.int32)
    for i in range(0, len(windows), 20000):
        part = windows[i:i + 20000]
        found = c.multi_compress_to_buffer(part, threads=0) if len(part) > 1 else [c.compress(part[0])]
        out[i:i + len(part)] = [len(x) for x in found]
    return out


def _frame(toxic: zstd.ZstdCompressor, texts: list[bytes]) -> int:
    """Bytes that every window spends on its frame: the median loss over all windows of ordinary texts. It belongs to the model, so that a
    text's score does not depend on the texts beside it."""
    losses = [np.zeros(0, np.int32)]
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        windows, _ = _windows(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        losses.append(_lengths(toxic, windows) - np.fromiter(map(len, windows), np.int32, len(windows)) + len(MARKER))
    losses = np.concatenate(losses)
    return max(0, int(np.median(losses))) if len(losses) else 0


def features(toxic: zstd.ZstdCompressor, ordinary: zstd.ZstdCompressor, data: np.ndarray, offsets: np.ndarray, frame: int) -> np.ndarray:
    """Per text: windows whose gain reaches each level, relative to the root of the window count and by themselves; largest gain."""
    windows, at = _windows(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, 3 * len(GAINS) + 2))
    if not windows:
        return out
    short, plain = _lengths(toxic, windows), np.fromiter(map(len, windows), np.int32, len(windows)) - len(MARKER)
    versus = _lengths(ordinary, windows) - short
    gain = plain - short + frame
    full = np.flatnonzero(np.diff(at))
    count = np.diff(at)[full]
    root = np.sqrt(np.maximum(count, 5))
    for k, g in enumerate(GAINS):
        hits = np.add.reduceat((gain >= g).astype(float), at[full])
        both = np.add.reduceat(((gain >= g) & (versus >= 2)).astype(float), at[full])
        out[full, k] = hits / root
        out[full, len(GAINS) + k] = both / root
        out[full, 2 * len(GAINS) + k] = np.log1p(both)
    out[full, -2] = np.maximum.reduceat(np.minimum(gain, versus), at[full])
    out[full, -1] = np.log1p(count)
    return out


def _distinct(texts: list[bytes]) -> list[list[bytes]]:
    """Word lists, leaving out texts that share half of a 12-hash sketch with an earlier one: copies would look like vocabulary."""
    import xxhash

    seen: dict[int, list[int]] = {}
    kept: list[list[bytes]] = []
    for t in texts:
        w = t.lower().split()
        sketch = sorted({xxhash.xxh64_intdigest(x) for x in w})[:12]
        near: dict[int, int] = {}
        for h in sketch:
            for i in seen.get(h, ()):
                near[i] = near.get(i, 0) + 1
        if near and 2 * max(near.values()) >= len(sketch):
            continue
        for h in sketch:
            seen.setdefault(h, []).append(len(kept))
        kept.append(w)
    return kept


def _vocabulary(texts: list[list[bytes]]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in texts:
        for x in set(w):
            out[x] = out.get(x, 0) + 1
    return out


def fit(texts: list[bytes], toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Trains dictionaries and curve on the given texts."""
    y = np.asarray(toxic, float)
    if not 0 < y.sum() < len(y):
        return Model(level=settings.level)
    bad, good = (_distinct([t for t, v in zip(texts, y) if v == k]) for k in (1, 0))
    vb, vg = _vocabulary(bad), _vocabulary(good)
    nb, ng = len(bad), max(1, len(good))
    marked = [w for w, c in vb.items() if c >= max(2, 0.01 * nb) and c / nb >= 8 * (vg.get(w, 0) + 0.5) / ng]
    size = settings.dictionary_bytes
    m = Model(level=settings.level)
    m.toxic = b" " + b" ".join(sorted(marked, key=lambda w: (vb[w], w)))[-size:]
    m.ordinary = b" " + b" ".join(sorted((w for w, c in vg.items() if c >= 3), key=lambda w: (vg[w], w)))[-size:]
    ct, co = _compressor(m.toxic, m.level), _compressor(m.ordinary, m.level)
    m.frame = _frame(ct, [t for t, v in zip(texts, y) if v == 0])
    rows = []
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        rows.append(features(ct, co, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), m.frame))
    x = np.concatenate(rows)
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - m.mean) / m.scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, 1.0), 1e-6]
    for _ in range(40):  # Newton steps; converges in about ten
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    # calibration: the fitted score that separates the classes best becomes the cut
    p = z @ w
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    edge = (p[order[k]] + p[order[min(k + 1, len(y) - 1)]]) / 2
    m.weights, m.bias = w[:-1], float(w[-1] - edge + np.log(settings.cut / (1 - settings.cut)))
    return m


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text") -> tuple[list[bytes], np.ndarray]:
    """The labelled rows to learn from: of each class the ``sample_rows`` ids of smallest hash, without texts above ``sample_text``.

    The ids are picked from the labels alone and are few, so only the sample is shuffled; of rows with one id the smallest text counts.
    """
    seen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    ids = [seen.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows) for k in (1, 0)]
    rows = (docs.select("doc_id", F.col(text).alias("text")).where(F.octet_length("text") <= settings.sample_text)
            .join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (-r["toxic"], r["doc_id"], r["text"]))
    return [r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(*sample(docs, labels, settings), settings)


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """Adds ``column``: between 0 and 1, higher is likelier toxic. A column of that name is replaced; all others pass untouched."""
    if column.lower() == text.lower():
        raise ValueError(f"the score can't replace the text column {text}")
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit(0.0)).schema

    def run(batches):
        ct, co = _compressor(model.toxic, model.level), _compressor(model.ordinary, model.level)
        for batch in blocks.freed(batches):
            data, offsets = blocks.utf8(batch.column(batch.schema.get_field_index(text)))
            out = np.zeros(batch.num_rows)
            for a, b in blocks.slices(offsets):
                if len(model.weights) == 0:
                    break
                at = offsets[a:b + 1]
                x = features(ct, co, data[at[0]:at[-1]], at - at[0], model.frame)
                p = ((x - model.mean) / model.scale) @ model.weights + model.bias
                out[a:b] = np.where(x[:, -1] > 0, 1 / (1 + np.exp(-np.clip(p, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
