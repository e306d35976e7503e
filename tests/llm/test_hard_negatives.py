import math

import numpy as np
import pytest
from test_vector_codes import SCHEMA, fine, frame_of, rows_of

from chaffline.llm import hard_negatives, queries


def brute(rows, every=50, n_positives=5, n_negatives=3):
    """By all pairs; rows of one id are told apart by their place in the list."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
        for i, v, label in rows if fine(v) and label is not None
    ]
    order = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), i, other == label) for k, (i, v, other) in enumerate(kept) if k != at]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=order)[:n_positives]:
            able = [s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, (own, negative, _) in enumerate(sorted(able, key=order)[:n_negatives], 1):
                out.append((anchor, positive, rank, negative, score, own))
    return out


def found(spark, tmp_path, rows):
    frame_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    return [tuple(r) for r in queries.hard_negative_mining(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_all_pairs(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks of rows and of anchors
        monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 1000)
    rows = rows_of(seed=4, n=200)
    got, expected = found(spark, tmp_path, rows), brute(rows)
    assert len({r[0] for r in expected}) > 5
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [(50, None, 1), (100, [1.0] * 8, None)]) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def coded(vectors):
    n = len(vectors)
    turned = hard_negatives.rotate(vectors)
    length = np.sqrt(np.square(vectors.astype(float)).sum(1))
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
    part = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    ids = np.arange(n)
    return hard_negatives.Coded(ids, ids, ids % 3, vectors, codes, length, np.where(length > 0, part / np.maximum(length, 1e-300), 1))


@pytest.mark.parametrize("size", [1, 5, 64, 100, 300])
def test_intervals_hold_the_scores(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(-200, 200, (5, size))
    vectors = centres[rng.integers(0, 5, 400)] + rng.integers(-9, 10, (400, size))
    vectors[0] = 0
    rows = coded(vectors)
    low, high = hard_negatives.Estimator(rows.take(slice(0, 60))).intervals(rows, slice(0, 60))
    exact = vectors[:60] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    if size >= 64:  # clusters are told apart by codes alone
        assert (high < exact.max(1)[:, None]).mean() > 0.5


def test_rotation_keeps_inner_products():
    vectors = np.random.default_rng(2).integers(-99, 99, (20, 70))
    turned = hard_negatives.rotate(vectors)
    assert turned.shape == (20, 128)
    assert np.allclose(turned @ turned.T, vectors @ vectors.T)


def test_large_products_stay_exact():
    a, b = np.full((1, 4), 2**30 + 1), np.full((1, 4), 2**30 - 1)
    assert hard_negatives.scores(a, b)[0, 0] == 4 * (2**30 + 1) * (2**30 - 1)
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.scores(a * 2, b * 2)
