import numpy as np
import pytest
from pyspark.sql import functions as F

from chaffline.functions import spectra
from chaffline.operators.neighbors import nearest_within
from chaffline.scorers import spectral
from chaffline.scorers.registry import get_scorer

HIDDEN = "sample_id long, layer int, token_pos int, vector array<float>"


def table(spark, samples):
    rows = [
        (i, layer, t, [float(x) for x in vector])
        for i, layers in enumerate(samples)
        for layer, matrix in enumerate(layers)
        for t, vector in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, HIDDEN)


def labels(spark, n):
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).alias("label"))


def entropy_rank(matrix):
    sigma = np.linalg.svd(np.asarray(matrix, dtype=np.float64), compute_uv=False)
    p = sigma / sigma.sum()
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def test_known_ranks():
    assert spectra.effective_rank(np.eye(5)) == pytest.approx(5.0)
    assert spectra.effective_rank(np.ones((10, 5))) == pytest.approx(1.0, abs=1e-5)
    assert spectra.effective_rank(np.zeros((4, 3))) == 1.0
    matrix = np.random.default_rng(0).normal(size=(20, 8))
    assert 1 <= spectra.effective_rank(matrix) <= 8
    assert spectra.effective_rank(matrix) == pytest.approx(entropy_rank(matrix))
    assert spectra.effective_rank(matrix.T) == pytest.approx(entropy_rank(matrix))


def test_compressed_rows_keep_the_spectrum():
    matrix = np.random.default_rng(1).normal(size=(500, 7))
    small = spectra.compress_rows(matrix)
    assert small.shape == (7, 7)
    assert np.allclose(spectra.singular_values(small), spectra.singular_values(matrix))


def test_layers_equal_numpy(spark):
    rng = np.random.default_rng(2)
    samples = [[rng.normal(size=(n, 6)) for _ in range(2)] for n in (2, 5, 40)]
    found = {
        (r.sample_id, r.layer): (r.n_tokens, r.effective_rank)
        for r in spectral.effective_rank_layers(table(spark, samples)).collect()
    }
    for i, layers in enumerate(samples):
        for j, matrix in enumerate(layers):
            n, value = found[(i, j)]
            assert n == len(matrix)
            assert value == pytest.approx(entropy_rank(matrix.astype(np.float32)), rel=1e-6)


def test_one_sample_with_most_rows(spark):
    rng = np.random.default_rng(3)
    samples = [[rng.normal(size=(30_000, 4))], [rng.normal(size=(5, 4))]]
    found = {r.sample_id: r for r in spectral.effective_rank_layers(table(spark, samples).repartition(4)).collect()}
    assert found[0].n_tokens == 30_000
    assert found[0].effective_rank == pytest.approx(entropy_rank(samples[0][0].astype(np.float32)), rel=1e-6)


def test_single_token_is_an_error(spark):
    with pytest.raises(Exception, match="at least 2"):
        spectral.effective_rank_layers(table(spark, [[np.ones((1, 3))]])).collect()


def test_low_rank_samples_rank_lower(spark):
    rng = np.random.default_rng(4)
    low = [[np.outer(rng.normal(size=16), rng.normal(size=32)) + 1e-3 * rng.normal(size=(16, 32))] for _ in range(10)]
    full = [[rng.normal(size=(16, 32))] for _ in range(10)]
    ranking = get_scorer("effective_rank").score(table(spark, low + full), labels(spark, 20)).collect()
    assert sorted(r.rank for r in ranking) == list(range(1, 21))
    assert {r.sample_id for r in ranking if r.rank <= 10} == set(range(10))
    assert {r.method for r in ranking} == {"effective_rank"}


def brute_dimension(points):
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    n = len(points)
    d = np.sort(gaps, axis=1)[:, : min(50, n - 1)]
    low, high = max(np.quantile(d, 0.02), 1e-12), np.quantile(d, 0.9)
    radii = np.logspace(np.log10(low), np.log10(high), 20)
    c = np.array([(d < r).sum(axis=1).mean() / (n - 1) for r in radii])
    x, y = np.log(radii[c > 1e-12]), np.log(c[c > 1e-12])
    m = len(x)
    return max(np.polyfit(x[m // 5 : m - m // 5], y[m // 5 : m - m // 5], 1)[0], 0.1)


@pytest.mark.parametrize("n, d", [(30, 2), (120, 5)])
def test_correlation_dimension(n, d):
    cloud = np.random.default_rng(5).normal(size=(n, d))
    assert spectra.correlation_dimension(cloud) == pytest.approx(brute_dimension(cloud), rel=1e-6)


def test_degenerate_clouds():
    assert spectra.correlation_dimension(np.ones((4, 3))) == 1.0
    assert spectra.correlation_dimension(np.ones((20, 3))) == 1.0


def test_correlation_scores_skip_short_layers(spark):
    rng = np.random.default_rng(6)
    samples = [[rng.normal(size=(30, 3)), rng.normal(size=(4, 3))], [rng.normal(size=(3, 3))]]
    found = {r.sample_id: r.score for r in spectral.correlation_scores(table(spark, samples)).collect()}
    assert found[0] == pytest.approx(brute_dimension(samples[0][0].astype(np.float32).astype(float)), rel=1e-6)
    assert found[1] == 1.0


def test_draw_keeps_the_same_points_each_time(spark):
    hidden = table(spark, [[np.random.default_rng(7).normal(size=(700, 2))]])
    drawn = [spectral.correlation_scores(h, max_points=300).first().score for h in (hidden, hidden.repartition(5))]
    assert drawn[0] == drawn[1]
    assert drawn[0] != spectral.correlation_scores(hidden).first().score


def test_all_points_of_a_long_layer_count(spark):
    points = np.random.default_rng(8).normal(size=(2000, 3)).astype(np.float32)
    found = spectral.correlation_scores(table(spark, [[points]])).first().score
    assert found == pytest.approx(brute_dimension(points.astype(float)), rel=1e-6)


@pytest.mark.parametrize("most", [50, 700])
def test_long_layers_are_measured_in_blocks(spark, monkeypatch, most):
    """Layers beyond the bound beside shorter ones; the same numbers as from one task each."""
    monkeypatch.setattr(spectral, "LAYER_POINTS", most)
    monkeypatch.setattr(spectral, "nearest_within", lambda p, k, keys: nearest_within(p, k, keys, rows_per_block=90))
    rng = np.random.default_rng(11)
    clouds = [[rng.normal(size=(n, d)) for n, d in own] for own in (((800, 3), (40, 2)), ((60, 4),), ((3, 2),), ((710, 2), (800, 1)))]
    clouds[1].append(np.ones((900, 2)))  # copies of one point
    hidden = table(spark, [[c.astype(np.float32) for c in own] for own in clouds])
    got = {r.sample_id: r.score for r in spectral.correlation_scores(hidden).collect()}
    for i, own in enumerate(clouds):
        layers = [spectra.correlation_dimension(c.astype(np.float32).astype(float)) for c in own if len(c) >= 5]
        assert got[i] == pytest.approx(np.mean(layers) if layers else 1.0, rel=1e-6)


def test_a_hot_layer_leaves_a_partition_as_one_factor(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(20_000, 6)).astype(np.float32)
    import pandas as pd

    frame = pd.DataFrame({"sample_id": 1, "layer": 1, "token_pos": np.arange(len(points)), "vector": points.tolist()})
    hidden = spark.createDataFrame(frame, HIDDEN).repartition(4)
    rows = hidden.selectExpr("sample_id", "layer", "1L AS n_tokens", "cast(vector as array<double>) AS vector")
    parts = rows.mapInArrow(spectral._compress_batches, spectral._PART)
    assert parts.count() <= 4 * 6
    row = spectral.effective_rank_layers(hidden).first()
    assert row.n_tokens == 20_000
    assert row.effective_rank == pytest.approx(entropy_rank(points), rel=1e-6)
