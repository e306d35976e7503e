import numpy as np
import pytest
from pyspark.sql import functions as F

from chaffline.functions import spectra
from chaffline.operators import neighbors
from chaffline.operators.neighbors import largest_similarity, nearest_distances
from chaffline.scorers import geometry
from chaffline.scorers.registry import get_scorer

VECTORS = "sample_id long, features array<float>"


def table(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], VECTORS)


def all_distances(matrix):
    m = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    gaps = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    return np.sort(gaps, axis=1)


def points(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


@pytest.mark.parametrize("blocks, bounded", [(None, None), (1, False), (3, False), (1, True), (8, True)])
@pytest.mark.parametrize("k", [1, 2, 7])
def test_nearest_equal_brute_force(spark, blocks, bounded, k):
    matrix = points(120, 6)
    matrix[40:60] = matrix[0]
    found = nearest_distances(table(spark, matrix), k, blocks=blocks, bounded=bounded).collect()
    expected = all_distances(matrix)[:, :k]
    assert len(found) == 120
    for r in found:
        assert r.distances == pytest.approx(expected[r.sample_id], abs=1e-9)


@pytest.mark.parametrize("bounded", [False, True])
def test_a_third_of_all_rows_being_copies(spark, bounded):
    matrix = points(900, 4, 1)
    matrix[:300] = matrix[0]
    rows = nearest_distances(table(spark, matrix), 2, blocks=12, bounded=bounded).collect()
    found = {r.sample_id: r.distances for r in rows}
    assert all(found[i] == [0.0, 0.0] for i in range(300))
    expected = all_distances(matrix)[:, :2]
    assert np.allclose([found[i] for i in range(900)], expected, atol=1e-9)


def test_fewer_neighbours_than_asked_for(spark):
    found = {r.sample_id: r.distances for r in nearest_distances(table(spark, [[0.0], [3.0]]), 5).collect()}
    assert found == {0: [3.0], 1: [3.0]}
    assert nearest_distances(table(spark, [[0.0]]), 2).first().distances == []
    assert nearest_distances(table(spark, [[0.0]]), 1).first().distances == []
    with pytest.raises(ValueError):
        nearest_distances(table(spark, [[0.0]]), 0)


def test_bounds_skip_pairs_of_blocks_and_stay_exact(spark, monkeypatch):
    """Tight clusters, one of them with a third of all rows."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 8)) * 50
    home = np.where(np.arange(1200) % 3 == 0, 0, rng.integers(0, 20, 1200))
    matrix = (centres[home] + rng.normal(size=(1200, 8)) * 0.1).astype(np.float32)
    seen = []
    visits = neighbors._visits

    def counting(bounded, k, limit):
        seen.append(bounded.agg(F.sum(F.size("targets")), F.countDistinct("block")).first())
        return visits(bounded, k, limit)

    monkeypatch.setattr(neighbors, "_visits", counting)
    rows = nearest_distances(table(spark, matrix), 3, blocks=40, bounded=True).collect()
    expected = all_distances(matrix)[:, :3]
    found = {r.sample_id: r.distances for r in rows}
    assert np.allclose([found[i] for i in range(1200)], expected, atol=1e-9)
    looked_at, blocks = seen[0]
    assert blocks >= 40 and looked_at < 0.3 * 1200 * blocks


def test_plan_of_blocks():
    assert neighbors.block_plan(0, 1, 8) == (1, False)
    assert neighbors.block_plan(100, 64, 8) == (1, False)
    assert neighbors.block_plan(2000, 64, 8) == (6, False)
    blocks, bounded = neighbors.block_plan(10**7, 64, 1000)
    assert bounded and 10**7 * 64 * 8 / blocks <= neighbors.BLOCK_BYTES
    blocks, _ = neighbors.block_plan(10**9, 512, 1000)
    assert 10**9 * 512 * 8 / blocks <= neighbors.BLOCK_BYTES


def test_more_blocks_than_rows(spark):
    matrix = points(5, 2, 12)
    rows = nearest_distances(table(spark, matrix), 2, blocks=9, bounded=True).collect()
    expected = all_distances(matrix)[:, :2]
    assert all(r.distances == pytest.approx(expected[r.sample_id]) for r in rows) and len(rows) == 5


@pytest.mark.parametrize("bounded", [False, True])
def test_similarity_equals_numpy(spark, bounded):
    matrix = points(150, 5, 13)
    matrix[3], matrix[4] = 0, matrix[9] * 2
    unit = matrix.astype(np.float64)
    unit /= np.where(np.linalg.norm(unit, axis=1, keepdims=True) > 0, np.linalg.norm(unit, axis=1, keepdims=True), 1)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    rows = largest_similarity(table(spark, matrix), blocks=6, bounded=bounded).collect()
    found = {r.sample_id: r.similarity for r in rows}
    assert [found[i] for i in range(150)] == pytest.approx(list(cosine.max(axis=1)), abs=1e-9)


def test_similarity_of_zero_equal_and_lone_vectors(spark):
    matrix = [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, -1.0]]
    found = {r.sample_id: r.similarity for r in largest_similarity(table(spark, matrix)).collect()}
    assert found == pytest.approx({0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0})
    pair = {r.sample_id: r.similarity for r in largest_similarity(table(spark, matrix[2:])).collect()}
    assert pair == {0: 0.0, 1: 0.0}
    zeros = largest_similarity(table(spark, [[0.0], [0.0]])).collect()
    assert [r.similarity for r in zeros] == [0.0, 0.0]
    assert largest_similarity(table(spark, [[0.0]])).first().similarity is None
    lone = geometry.redundancy_scores(table(spark, [[1.0, 1.0]])).first()
    assert lone.score == 2.0


def test_copies_go_first(spark):
    matrix = points(30, 5, 2)
    matrix[7] = matrix[21]
    rows = table(spark, matrix).withColumn("label", F.lit(0))
    ranking = get_scorer("semantic_dedup").score(rows).orderBy("rank").limit(2).collect()
    assert [r.sample_id for r in ranking] == [7, 21] and ranking[0].score == 0.0


def brute_twonn(matrix):
    r = all_distances(matrix)
    ratio = np.sort(np.maximum(r[:, 1] / r[:, 0], 1 + 1e-12))
    n = len(ratio)
    x, y = np.log(ratio), -np.log(1 - np.arange(1, n + 1) / (n + 1))
    return max((x @ y) / (x @ x), 1.0), ratio


def test_twonn_equals_numpy(spark):
    basis = points(3, 12, 3)
    matrix = points(64, 3, 4) @ basis
    row = geometry.twonn_dimension(table(spark, matrix)).first()
    dimension, ratio = brute_twonn(matrix)
    assert row.dimension == pytest.approx(dimension, rel=1e-6) and 1 < row.dimension < 8
    assert row.median_ratio == pytest.approx(np.median(ratio), rel=1e-9)
    assert row.min_ratio >= 1 and row.max_ratio == pytest.approx(ratio[-1])


def test_twonn_needs_three_samples_and_varied_ratios(spark):
    with pytest.raises(ValueError, match="3 samples"):
        geometry.twonn_dimension(table(spark, [[0.0], [1.0]]))


def test_density_score(spark):
    matrix = points(50, 4, 5)
    found = {r.sample_id: r.score for r in geometry.knn_density(table(spark, matrix), 3).collect()}
    expected = all_distances(matrix)[:, :3].mean(axis=1)
    assert [found[i] for i in range(50)] == pytest.approx(list(expected), abs=1e-6)


def test_reduction_keeps_distances_of_numpy_components(spark):
    matrix = points(60, 6, 6) * np.array([5, 3, 1, 0.1, 0.1, 0.1], dtype=np.float32)
    reduced = geometry.reduce_features(table(spark, matrix), 3.7).orderBy("sample_id").collect()
    found = np.array([r.reduced for r in reduced])
    centred = matrix.astype(np.float64) - matrix.mean(axis=0, dtype=np.float64)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    expected = centred @ axes[:3].T
    assert found.shape == (60, 3)
    assert np.allclose(all_distances(found), all_distances(expected), atol=1e-4)


@pytest.mark.parametrize("dimension, components", [(0.2, 1), (2.9, 2), (100.0, 4)])
def test_components_stay_within_the_shape(spark, dimension, components):
    row = geometry.reduce_features(table(spark, points(20, 4, 7)), dimension).first()
    assert len(row.reduced) == components


def test_intrinsic_dimension_ranking_equals_numpy(spark):
    matrix = points(40, 8, 8)
    rows = table(spark, matrix).withColumn("label", F.lit(1))
    ranking = get_scorer("intrinsic_dimensionality_twonn").score(rows).orderBy("rank").collect()
    k = int(np.clip(np.floor(brute_twonn(matrix)[0]), 1, 8))
    centred = matrix.astype(np.float64) - matrix.mean(axis=0, dtype=np.float64)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    score = all_distances((centred @ axes[:k].T).astype(np.float32))[:, :2].mean(axis=1)
    assert [r.rank for r in ranking] == list(range(40))
    assert [r.score for r in ranking] == pytest.approx(sorted(score), abs=1e-5)


def test_table_dimension_equals_the_one_matrix_measure(spark):
    matrix = points(80, 3, 9)
    row = geometry.correlation_dimension(table(spark, matrix)).first()
    assert row.dimension == pytest.approx(spectra.correlation_dimension(matrix), rel=1e-6)
    assert geometry.correlation_dimension(table(spark, matrix[:4])).first().dimension == 1.0
    same = np.ones((9, 2), dtype=np.float32)
    assert geometry.correlation_dimension(table(spark, same)).first().dimension == 1.0


@pytest.mark.parametrize("rows_per_block", [4096, 40])
def test_approximate_neighbours(spark, rows_per_block):
    from chaffline.operators.neighbors import approximate_distances

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 8)) * 10
    points = centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 8)) * 0.2
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "sample_id long, features array<double>")
    found = {r.sample_id: r.distances for r in approximate_distances(frame, 3, 2.0, rows_per_block=rows_per_block).collect()}
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    exact = np.sort(gaps, 1)[:, :3]
    hits = sum(np.isclose(found[i][:3], exact[i][: len(found[i])]).sum() for i in range(600))
    recall = hits / exact.size
    print(f"recall of the approximate neighbours: {recall:.3f}")
    assert recall >= 0.95
    assert all((np.array(found[i]) >= exact[i][: len(found[i])] - 1e-9).all() for i in range(600))


def test_approximate_distances_keep_ties(spark):
    """Equal vectors are neighbours of each other, however often they meet."""
    rows = [[1.0, 2.0]] * 4 + [[9.0, 9.0], [9.0, 9.5]]
    found = {r.sample_id: r.distances for r in neighbors.approximate_distances(table(spark, rows), 2, 2.0).collect()}
    assert all(found[i] == [0.0, 0.0] for i in range(4))


def test_few_pairs_are_measured_exactly():
    """Vectors without structure: the rough products rule out nearly all pairs, and nothing is lost."""
    matrix = np.random.default_rng(4).normal(size=(5000, 64)) + 100.0
    best, rows = neighbors._Best(1000, 5), neighbors._Rough(matrix, matrix.mean(axis=0))
    measured = 0
    for theirs in neighbors._tiles(len(matrix)):
        rough = neighbors._rough_tile(rows, rows, slice(0, 1000), theirs)
        if theirs.start == 0:
            np.fill_diagonal(rough, np.inf)
        measured += neighbors._offer(best, rows, rows, slice(0, 1000), theirs, rough)
    every = np.array([np.sort(np.sqrt(((matrix - v) ** 2).sum(1)))[1:6] for v in matrix[:1000]])
    assert np.allclose(best.values(), every, rtol=1e-12)
    assert measured < 0.01 * 1000 * len(matrix)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_vectors_with_many_visits_are_compared_by_packs_and_not_sent(spark, monkeypatch, k):
    """Before, vectors without structure were copied to every block: the rows shuffled grew with the square."""
    matrix = points(1500, 12, 3)
    matrix[40:60] = matrix[0]
    sent, met = [], []
    visits, packs = neighbors._visits, neighbors._packs_met

    def counting(bounded, *rest):
        sent.append(bounded.agg(F.max(F.size("targets")), F.sum(F.size("targets"))).first())
        return visits(bounded, *rest)

    def looking(*given):
        met.append(packs(*given))
        return met[-1]

    monkeypatch.setattr(neighbors, "_visits", counting)
    monkeypatch.setattr(neighbors, "_packs_met", looking, raising=False)
    rows = nearest_distances(table(spark, matrix), k, blocks=30, bounded=True).collect()
    found = {r.sample_id: r.distances for r in rows}
    assert np.allclose([found[i] for i in range(1500)], all_distances(matrix)[:, :k], atol=1e-9)
    assert sent[0][0] <= 8 and sent[0][1] < 4 * 1500
    # A row comes once for each task that met its pack, not for each block.
    assert met[0].groupBy("sample_id").count().agg(F.max("count")).first()[0] <= 6


def test_packs_hold_blocks_of_any_size(spark, monkeypatch):
    """One block of half the table is dealt over several packs."""
    monkeypatch.setattr(neighbors, "PACK_BYTES", 8 * 5 * 64)
    matrix = points(700, 5, 4)
    rows = nearest_distances(table(spark, matrix), 2, blocks=20, bounded=True).collect()
    found = {r.sample_id: r.distances for r in rows}
    assert np.allclose([found[i] for i in range(700)], all_distances(matrix)[:, :2], atol=1e-9)


def test_a_vector_is_written_twice_in_the_precision_of_its_table(spark, monkeypatch):
    """Before, vectors were written four times in double precision, and their values by every task that met them."""
    matrix = points(3000, 48, 5)
    written, met = [], []
    cut, packs = neighbors.cut_lineage, neighbors._packs_met

    def weighing(frame):
        frame = cut(frame)
        sizes = [F.length(c) if t == "binary" else F.size(c) * 4 * (1 + (t == "array<double>")) for c, t in frame.dtypes
                 if c in ("vector", "vectors") or c.endswith("_vectors")]
        written.extend(frame.agg(F.sum(size)).first()[0] for size in sizes)
        return frame

    def looking(*given):
        met.append(packs(*given))
        return met[-1]

    monkeypatch.setattr(neighbors, "cut_lineage", weighing)
    monkeypatch.setattr(neighbors, "_packs_met", looking)
    rows = nearest_distances(table(spark, matrix), 2, blocks=30, bounded=True).collect()
    found = {r.sample_id: r.distances for r in rows}
    assert np.allclose([found[i] for i in range(3000)], all_distances(matrix)[:, :2], atol=1e-9)
    assert sum(written) <= 2 * matrix.nbytes
    assert met[0].groupBy("sample_id").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_few_vectors_that_ask_get_packs_of_their_own(spark, monkeypatch, kind):
    """Tight clusters, and scattered vectors that have to look at many blocks."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 4
    matrix = np.concatenate([centres[np.arange(1200) % 20] + rng.normal(size=(1200, 16)) * 0.01, rng.normal(size=(150, 16)) * 4])
    matrix = matrix.astype(np.float32)
    asked = []
    plan = neighbors._pack_plan

    def counting(sizes, *rest):
        asked.append(sum(sizes.values()))
        return plan(sizes, *rest)

    monkeypatch.setattr(neighbors, "_pack_plan", counting)
    vectors = table(spark, matrix).withColumn("features", F.col("features").cast(f"array<{kind}>"))
    found = {r.sample_id: r.distances for r in nearest_distances(vectors, 3, blocks=40, bounded=True).collect()}
    assert np.allclose([found[i] for i in range(1350)], all_distances(matrix)[:, :3], atol=1e-9)
    assert len(asked) == 2 and 0 < asked[1] < 1350 / 2


@pytest.mark.parametrize("bounded", [False, True])
def test_directions_are_shuffled_and_written_in_the_precision_of_the_table(spark, monkeypatch, bounded):
    """Before, unit vectors were made ahead of the search and moved in double precision."""
    matrix = points(3000, 48, 14)
    moved, written = [], []
    cut, pairs, visits = neighbors.cut_lineage, neighbors._per_pair, neighbors._visits

    def weighing(frame):
        frame = cut(frame)
        sizes = [F.length(c) if t == "binary" else F.size(c) * 4 * (1 + (t == "array<double>")) for c, t in frame.dtypes
                 if c in ("vector", "vectors") or c.endswith("_vectors")]
        written.extend(frame.agg(F.sum(size)).first()[0] for size in sizes)
        return frame

    def dealing(step):
        def deal(rows, *rest, **options):
            moved.append(dict(rows.dtypes)["vector"])
            return step(rows, *rest, **options)

        return deal

    monkeypatch.setattr(neighbors, "cut_lineage", weighing)
    monkeypatch.setattr(neighbors, "_per_pair", dealing(pairs))
    monkeypatch.setattr(neighbors, "_visits", dealing(visits))
    rows = largest_similarity(table(spark, matrix), blocks=30 if bounded else 4, bounded=bounded).collect()
    unit = matrix.astype(np.float64) / np.linalg.norm(matrix.astype(np.float64), axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    found = {r.sample_id: r.similarity for r in rows}
    assert np.allclose([found[i] for i in range(3000)], cosine.max(axis=1), atol=1e-9)
    assert moved == ["array<float>"]
    assert len(written) == 2 * bounded and sum(written) <= 2 * matrix.nbytes
