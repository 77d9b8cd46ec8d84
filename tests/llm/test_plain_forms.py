"""Packing against its contract in plain Python, and columns, nulls and empty tables of the toxicity score."""

import numpy as np
import pytest

from flowlantern.llm import packing, toxicity


@pytest.mark.parametrize("seed", range(40))
def test_packing_covers_every_id_once(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = [int(n) for n in rng.choice([1, 2, 31, 63, 64, 65, 200], 30)] + [int(n) for n in rng.integers(1, 300, rng.integers(0, 40))]
    pieces = packing.pack(lengths, size)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, length, _, _ in sorted((p for p in pieces if p[0] == d), key=lambda p: p[1]):
            assert start == at and length > 0
            at += length
        assert at == n
    used = {}
    for _, _, length, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used.get(seq, 0)  # gapless from 0
        used[seq] = offset + length
    assert all(n == size or (n < size and n & (n - 1) == 0) for n in used.values())


def test_packing_nothing():
    assert packing.pack([], 64) == []


def _model(spark):
    d = spark.createDataFrame([(i, ("calm words " + ("vile scumbag " * 3 if i % 4 == 0 else "") + f"{i} day after day ") * 3)
                               for i in range(120)], "doc_id long, text string")
    return d, toxicity.train(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(90)], "doc_id long, toxic int"))


def test_score_replaces_a_column_of_its_name(spark):
    d, model = _model(spark)
    plain = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    clash = d.selectExpr("'x' AS Score", "doc_id", "text", "array(1, 2) AS kept")
    got = toxicity.score(clash, model)
    assert got.columns == ["doc_id", "text", "kept", "score"]
    assert {r["doc_id"]: r["score"] for r in got.collect()} == plain
    with pytest.raises(ValueError, match="text column"):
        toxicity.score(d, model, "text")


def test_score_of_an_empty_table_and_without_labels(spark):
    d, model = _model(spark)
    assert toxicity.score(d.where("false"), model).count() == 0
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {0.0}
