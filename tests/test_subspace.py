import numpy as np
import pytest

from chaffline.operators import subspace
from chaffline.scorers import geometry


def cloud(n, width, rank, seed=1):
    rng = np.random.default_rng(seed)
    strong = rng.normal(size=(n, rank)) * np.linspace(9, 3, rank)
    return strong @ np.linalg.qr(rng.normal(size=(width, rank)))[0].T + rng.normal(size=(n, width)) * 0.002 + 5.0


def table(spark, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "sample_id long, features array<double>").repartition(3).persist()


def test_axes_equal_numpy(spark):
    matrix = cloud(150, 60, 5)
    axes = subspace.principal_axes(table(spark, matrix), 4)
    expected = np.linalg.svd(matrix - matrix.mean(0), full_matrices=False)[2][:4].T
    assert np.allclose(np.abs((axes * expected).sum(0)), 1, atol=1e-8)


def test_twenty_thousand_features(spark):
    """Far beyond what a covariance matrix allows; distances are those along the true axes."""
    matrix = cloud(80, 20_000, 3)
    rows = geometry.reduce_features(table(spark, matrix), 3.4).collect()
    found = np.array([r.reduced for r in sorted(rows)])
    left = matrix @ np.linalg.svd(matrix - matrix.mean(0), full_matrices=False)[2][:3].T
    gaps = lambda m: np.sqrt(np.square(m[:, None] - m[None]).sum(-1))
    assert found.shape == (80, 3) and np.allclose(gaps(found), gaps(left), atol=1e-3)


def test_fewer_rows_than_directions(spark):
    matrix = cloud(3, 40, 2)
    assert subspace.principal_axes(table(spark, matrix), 2).shape == (40, 2)
    assert np.isfinite(subspace.principal_axes(table(spark, np.ones((4, 30))), 2)).all()


def test_a_block_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(subspace, "BLOCK_VALUES", 100)
    with pytest.raises(ValueError, match="directions"):
        subspace.principal_axes(table(spark, cloud(20, 30, 2)), 2)
