"""Queries over feature vectors, hidden states, logits and feature maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaffline.functions import vectors as V
from chaffline.operators import metrics, prep
from chaffline.operators.neighbors import nearest_distances
from chaffline.plans.views import (
    HIDDEN_STATES,
    LOGITS,
    feature_maps,
    features,
    hidden_labels,
    hidden_states,
    logits,
)
from chaffline.scorers import geometry, spectral
from chaffline.scorers.model_outputs import distributions_from_logits
from chaffline.scorers.registry import get_scorer

NEIGHBOURS = 5
CAP = 8

DOUBLES = """points AS (
  SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings)"""
DISTANCES = """distances AS (
  SELECT a.sample_id, round(list_distance(a.v, b.v), 6) AS distance,
         row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.v, b.v), b.sample_id) AS place
  FROM points a JOIN points b ON a.sample_id <> b.sample_id)"""
EXACT = """raw AS (
  SELECT a.sample_id, list_distance(a.v, b.v) AS distance
  FROM points a JOIN points b ON a.sample_id <> b.sample_id),
placed AS (
  SELECT sample_id, distance, row_number() OVER (PARTITION BY sample_id ORDER BY distance) AS place
  FROM raw)"""


def knn_exact(spark, folder):
    found = nearest_distances(features(spark, folder), NEIGHBOURS)
    return found.select("sample_id", F.posexplode("distances").alias("_i", "distance")).select(
        "sample_id", (F.col("_i") + 1).alias("place"), F.round("distance", 6).alias("distance")
    )


def knn_bounded(spark, folder):
    """The same by bounds, which larger tables get by themselves, over eight blocks."""
    found = nearest_distances(features(spark, folder), NEIGHBOURS, blocks=8, bounded=True)
    return found.select("sample_id", F.posexplode("distances").alias("_i", "distance")).select(
        "sample_id", (F.col("_i") + 1).alias("place"), F.round("distance", 6).alias("distance")
    )


def twonn_dimension(spark, folder):
    row = geometry.twonn_dimension(features(spark, folder))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def pca_reduce(spark, folder):
    """Number of components and the length of each reduced vector, which signs do not change."""
    points = features(spark, folder)
    dimension = geometry.twonn_dimension(points).first().dimension
    return geometry.reduce_features(points, dimension).select(
        "sample_id",
        F.size("reduced").alias("n_components"),
        F.round(V.length(F.col("reduced")), 4).alias("length"),
    )


def correlation_dimension(spark, folder):
    return geometry.correlation_dimension(features(spark, folder)).select(
        F.round("dimension", 6).alias("dimension")
    )


def scored(method, frame, labels=None):
    def query(spark, folder):
        return get_scorer(method).score(
            frame(spark, folder), labels(spark, folder) if labels else None
        )

    return query


def inner_layers(spark, folder):
    """Hidden states without the embedding layer, which is never scored."""
    return prep.drop_embedding_layer(hidden_states(spark, folder))


def effective_rank_layers(spark, folder):
    return spectral.effective_rank_layers(hidden_states(spark, folder)).withColumn(
        "effective_rank", F.round("effective_rank", 6)
    )


def rank_entropy(spark, folder):
    rows = logits(spark, folder)
    labels = rows.groupBy("sample_id").agg(F.min("label").alias("label"))
    return get_scorer("llm_classifier").score(distributions_from_logits(rows), labels)


def token_cap(spark, folder):
    return shape(prep.cap_tokens(hidden_states(spark, folder), CAP))


def last_layer_tokens(spark, folder):
    return shape(prep.last_layer(prep.drop_embedding_layer(hidden_states(spark, folder))))


def shape(hidden):
    """Token rows with their first entry and length in place of the whole vector."""
    return hidden.select(
        "sample_id",
        "layer",
        "token_pos",
        F.get("vector", F.lit(0)).cast("double").alias("first_entry"),
        F.round(V.length(F.col("vector")), 6).alias("length"),
    )


SHAPE = """sample_id, layer, token_pos, CAST(vector[1] AS DOUBLE) AS first_entry,
  round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length"""


def mean_pool(spark, folder):
    pooled = prep.mean_pool(hidden_states(spark, folder))
    return pooled.select("sample_id", F.posexplode("features").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


def feature_map_points(spark, folder):
    points = prep.feature_map_points(feature_maps(spark, folder))
    return points.select(
        "sample_id", "position", F.posexplode("point").alias("channel", "value")
    ).withColumn("value", F.col("value").cast("double"))


def evaluate_predictions(spark, folder):
    rows = metrics.evaluate_predictions(logits(spark, folder), "run", "epoch")
    return rows.select(
        "run", "epoch", "n", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss")
    )


RANKED = """SELECT sample_id, label, CAST(score AS DOUBLE) AS score,
       row_number() OVER (ORDER BY score, sample_id) - 1 AS rank, '{method}' AS method FROM scores"""

# Correlation dimension per (sample, layer) of 5 or more points, then the mean over layers.
CORR_INTEGRAL_SQL = f"""WITH {HIDDEN_STATES},
rows_ AS (
  SELECT sample_id, layer, token_pos, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v,
         count(*) OVER (PARTITION BY sample_id, layer) AS n
  FROM hidden_states WHERE layer >= 1),
pairs AS (
  SELECT a.sample_id, a.layer, a.n, list_distance(a.v, b.v) AS d
  FROM rows_ a JOIN rows_ b
    ON a.sample_id = b.sample_id AND a.layer = b.layer AND a.token_pos <> b.token_pos
  WHERE a.n >= 5),
bounds AS (
  SELECT sample_id, layer, any_value(n) AS n,
         greatest(quantile_cont(d, 0.02::DOUBLE), 1e-12::DOUBLE) AS low,
         quantile_cont(d, 0.9::DOUBLE) AS high
  FROM pairs GROUP BY ALL),
radii AS (
  SELECT *, pow(10::DOUBLE, log10(low) + i * (log10(high) - log10(low)) / 19) AS r
  FROM bounds, (SELECT unnest(range(20)) AS i)),
curve AS (
  SELECT sample_id, layer, i, ln(any_value(r)) AS x,
         count(*) FILTER (d < r) / CAST(any_value(n) AS DOUBLE) / (any_value(n) - 1) AS c
  FROM radii JOIN (SELECT sample_id, layer, d FROM pairs) USING (sample_id, layer) GROUP BY ALL),
valid AS (
  SELECT sample_id, layer, x, ln(c) AS y,
         row_number() OVER (PARTITION BY sample_id, layer ORDER BY i) - 1 AS k,
         count(*) OVER (PARTITION BY sample_id, layer) AS m
  FROM curve WHERE c > 1e-12::DOUBLE),
layers AS (
  SELECT sample_id, layer, CASE WHEN any_value(m) < 3 THEN 1.0::DOUBLE
    ELSE greatest(regr_slope(y, x), 0.1::DOUBLE) END AS dimension
  FROM valid WHERE m - 2 * (m // 5) < 3 OR (k >= m // 5 AND k < m - m // 5) GROUP BY ALL),
scores AS (
  SELECT sample_id, any_value(label) AS label, round(coalesce(avg(dimension), 1.0::DOUBLE), 9) AS score
  FROM (SELECT vec_id // 40 AS sample_id, CAST(min(label) AS BIGINT) AS label
        FROM embeddings GROUP BY 1) LEFT JOIN layers USING (sample_id) GROUP BY sample_id)
SELECT sample_id, label, score, row_number() OVER (ORDER BY score, sample_id) AS rank,
       'corr_integral' AS method FROM scores"""

# Singular values by Jacobi rotations of each layer's Gram matrix, one pair of rows a step, as many
# sweeps over all pairs as ten tokens need to reach full precision.
SPECTRA_SQL = f"""{HIDDEN_STATES},
layers AS (
  SELECT sample_id, layer, count(*) AS m,
         list(list_transform(vector, lambda x: CAST(x AS DOUBLE)) ORDER BY token_pos) AS tokens
  FROM hidden_states GROUP BY ALL),
pairs AS (
  SELECT m, p, q, row_number() OVER (PARTITION BY m ORDER BY p, q) - 1 AS i, count(*) OVER (PARTITION BY m) AS n
  FROM (SELECT DISTINCT m FROM layers), (SELECT unnest(range(64)) AS p), (SELECT unnest(range(64)) AS q)
  WHERE p < q AND q < m),
turns(sample_id, layer, m, step, a) AS (
  SELECT sample_id, layer, m, CAST(0 AS BIGINT),
         list_transform(range(m * m), lambda k: list_dot_product(tokens[k // m + 1], tokens[k % m + 1]))
  FROM layers
  UNION ALL
  SELECT sample_id, layer, m, step + 1, list_transform(range(m * m), lambda k:
    CASE WHEN k // m = p THEN c * h[p * m + k % m + 1] - s * h[q * m + k % m + 1]
         WHEN k // m = q THEN s * h[p * m + k % m + 1] + c * h[q * m + k % m + 1] ELSE h[k + 1] END)
  FROM (SELECT *, list_transform(range(m * m), lambda k:
      CASE WHEN k % m = p THEN c * a[k // m * m + p + 1] - s * a[k // m * m + q + 1]
           WHEN k % m = q THEN s * a[k // m * m + p + 1] + c * a[k // m * m + q + 1] ELSE a[k + 1] END) AS h
    FROM (SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s
      FROM (SELECT *, CASE WHEN z IS NULL THEN 0
                           ELSE (CASE WHEN z < 0 THEN -1 ELSE 1 END) / (abs(z) + sqrt(1 + z * z)) END AS t
        FROM (SELECT *, CASE WHEN abs(a[p * m + q + 1]) > 1e-300::DOUBLE
                             THEN (a[q * m + q + 1] - a[p * m + p + 1]) / (2 * a[p * m + q + 1]) END AS z
          FROM (SELECT turns.*, p, q FROM turns JOIN pairs ON pairs.m = turns.m AND i = step % n)))))
  WHERE step < 450),
spectra AS (
  SELECT sample_id, layer, m,
         list_transform(range(m), lambda i: sqrt(greatest(a[i * m + i + 1], 0.0::DOUBLE))) AS sigma
  FROM turns WHERE step = 450),
ranks AS (
  SELECT sample_id, layer, m AS n_tokens, CASE WHEN list_sum(sigma) < 1e-12::DOUBLE THEN 1.0::DOUBLE
    ELSE exp(-list_sum(list_transform(sigma, lambda x: x / list_sum(sigma)
             * ln(greatest(x / list_sum(sigma), 1e-12::DOUBLE))))) END AS effective_rank
  FROM spectra)"""

RATIOS_SQL = """ratios AS (
  SELECT sample_id, greatest(
    greatest(max(distance) FILTER (place = 2), 1e-12::DOUBLE)
    / greatest(max(distance) FILTER (place = 1), 1e-12::DOUBLE), 1 + 1e-12::DOUBLE) AS ratio
  FROM placed WHERE place <= 2 GROUP BY sample_id),
xy AS (
  SELECT ratio, ln(ratio) AS x,
         -ln(1 - row_number() OVER (ORDER BY ratio, sample_id) / CAST(count(*) OVER () + 1 AS DOUBLE)) AS y
  FROM ratios)"""

# Principal axes by Jacobi rotations of the covariance, 32 disjoint pairs of the 64 columns a step: in
# round r column 63 meets column r, and any two others whose numbers add up to 2 r modulo 63.
REDUCED_SQL = f"""{DOUBLES}, {EXACT}, {RATIOS_SQL},
entries AS (SELECT sample_id, unnest(range(64)) AS i, unnest(v) AS x FROM points),
centred AS (SELECT sample_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM entries),
covariance AS (
  SELECT list(x ORDER BY k) AS a FROM (
    SELECT a.i * 64 + b.i AS k, sum(a.x * b.x) / ((SELECT count(*) FROM points) - 1) AS x
    FROM centred a JOIN centred b USING (sample_id) GROUP BY 1)),
turns(step, a, v) AS (
  SELECT 0, a, list_transform(range(4096), lambda k: CAST(CAST(k // 64 = k % 64 AS INTEGER) AS DOUBLE))
  FROM covariance
  UNION ALL
  SELECT step + 1,
    list_transform(range(4096), lambda k:
      c[k // 64 + 1] * (c[k % 64 + 1] * a[k + 1] + s[k % 64 + 1] * a[k // 64 * 64 + w[k % 64 + 1] + 1])
      + s[k // 64 + 1] * (c[k % 64 + 1] * a[w[k // 64 + 1] * 64 + k % 64 + 1]
                          + s[k % 64 + 1] * a[w[k // 64 + 1] * 64 + w[k % 64 + 1] + 1])),
    list_transform(range(4096), lambda k:
      c[k // 64 + 1] * v[k + 1] + s[k // 64 + 1] * v[w[k // 64 + 1] * 64 + k % 64 + 1])
  FROM (SELECT *, list_transform(t, lambda x: 1 / sqrt(1 + x * x)) AS c,
               list_transform(range(64), lambda i:
                 (CASE WHEN i < w[i + 1] THEN -1 ELSE 1 END) * t[i + 1] / sqrt(1 + t[i + 1] * t[i + 1])) AS s
    FROM (SELECT *, list_transform(z, lambda x: CASE WHEN x IS NULL THEN 0
                 ELSE (CASE WHEN x < 0 THEN -1 ELSE 1 END) / (abs(x) + sqrt(1 + x * x)) END) AS t
      FROM (SELECT *, list_transform(range(64), lambda i:
                 CASE WHEN abs(a[i * 64 + w[i + 1] + 1]) > 1e-300::DOUBLE THEN
                   (a[greatest(i, w[i + 1]) * 65 + 1] - a[least(i, w[i + 1]) * 65 + 1])
                   / (2 * a[i * 64 + w[i + 1] + 1]) END) AS z
        FROM (SELECT *, list_transform(range(64), lambda i: CASE WHEN i = 63 THEN step % 63
                 WHEN i = step % 63 THEN 63 ELSE (2 * (step % 63) - i + 126) % 63 END) AS w
              FROM turns WHERE step < 567))))),
axes AS (
  SELECT v[i * 64 + 1:i * 64 + 64] AS axis, row_number() OVER (ORDER BY a[i * 65 + 1] DESC) AS place
  FROM (SELECT a, v, unnest(range(64)) AS i FROM turns WHERE step = 567)),
chosen AS (
  SELECT axis, place FROM axes WHERE place <= least((SELECT count(*) FROM points),
    (SELECT greatest(floor(greatest(sum(x * y) / sum(x * x), 1.0::DOUBLE)), 1) FROM xy))),
reduced AS (
  SELECT sample_id, any_value(label) AS label,
         list(CAST(CAST(list_dot_product(v, axis) AS FLOAT) AS DOUBLE) ORDER BY place) AS r
  FROM points, chosen GROUP BY sample_id)"""

QUERIES = {
    "knn_exact": (
        knn_exact,
        f"""WITH {DOUBLES}, {DISTANCES}
        SELECT sample_id, CAST(place AS INTEGER) AS place, distance FROM distances
        WHERE place <= {NEIGHBOURS}""",
    ),
    "knn_bounded": (
        knn_bounded,
        f"""WITH {DOUBLES}, {DISTANCES}
        SELECT sample_id, CAST(place AS INTEGER) AS place, distance FROM distances
        WHERE place <= {NEIGHBOURS}""",
    ),
    "knn_density": (
        lambda spark, folder: geometry.knn_density(features(spark, folder)),
        f"""WITH {DOUBLES}, {EXACT}
        SELECT sample_id, round(sum(distance) / 2, 6) AS score FROM placed WHERE place <= 2
        GROUP BY sample_id""",
    ),
    "twonn_dimension": (
        twonn_dimension,
        f"""WITH {DOUBLES}, {EXACT}, {RATIOS_SQL}
        SELECT round(greatest(sum(x * y) / sum(x * x), 1.0::DOUBLE), 6) AS dimension,
               round(avg(ratio), 6) AS mean_ratio,
               round(quantile_cont(ratio, 0.5::DOUBLE), 6) AS median_ratio,
               round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio
        FROM xy""",
    ),
    "pca_reduce": (
        pca_reduce,
        f"""WITH RECURSIVE {REDUCED_SQL}
        SELECT sample_id, CAST(len(r) AS INTEGER) AS n_components,
               round(sqrt(list_dot_product(r, r)), 4) AS length FROM reduced""",
    ),
    "correlation_dimension": (
        correlation_dimension,
        f"""WITH {DOUBLES}, {EXACT},
        size AS (SELECT count(*) AS n FROM points),
        d AS (SELECT distance FROM placed, size WHERE place <= least(50, n - 1)),
        bounds AS (
          SELECT greatest(quantile_cont(distance, 0.02::DOUBLE), 1e-12::DOUBLE) AS low,
                 quantile_cont(distance, 0.9::DOUBLE) AS high FROM d),
        radii AS (
          SELECT i, pow(10::DOUBLE, log10(low) + i * (log10(high) - log10(low)) / 19) AS r
          FROM bounds, (SELECT unnest(range(20)) AS i)),
        curve AS (
          SELECT i, ln(r) AS x, count(*) FILTER (distance < r) / CAST(n AS DOUBLE) / (n - 1) AS c
          FROM radii, d, size GROUP BY i, r, n),
        valid AS (
          SELECT x, ln(c) AS y, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS m
          FROM curve WHERE c > 1e-12::DOUBLE)
        SELECT round(greatest(regr_slope(y, x), 0.1::DOUBLE), 6) AS dimension
        FROM valid WHERE k >= m // 5 AND k < m - m // 5""",
    ),
    "rank_semantic_dedup": (
        scored("semantic_dedup", features),
        f"""WITH {DOUBLES},
        unit AS (
          SELECT sample_id, label, list_transform(v, lambda x: x / CASE WHEN size < 1e-12::DOUBLE THEN 1 ELSE size END) AS u
          FROM (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM points)),
        scores AS (
          SELECT a.sample_id, any_value(a.label) AS label,
                 CAST(round(1 - max(list_dot_product(a.u, b.u)), 6) AS FLOAT) AS score
          FROM unit a JOIN unit b ON a.sample_id <> b.sample_id GROUP BY a.sample_id)
        {RANKED.format(method='semantic_dedup')}""",
    ),
    "rank_intrinsic_dim": (
        scored("intrinsic_dimensionality_twonn", features),
        f"""WITH RECURSIVE {REDUCED_SQL},
        gaps AS (
          SELECT a.sample_id, any_value(a.label) AS label, min(list_distance(a.r, b.r), 2) AS nearest
          FROM reduced a JOIN reduced b ON a.sample_id <> b.sample_id GROUP BY a.sample_id),
        scores AS (SELECT sample_id, label, CAST(round(list_avg(nearest), 6) AS FLOAT) AS score FROM gaps)
        {RANKED.format(method='intrinsic_dimensionality_twonn')}""",
    ),
    "effective_rank_layers": (
        effective_rank_layers,
        f"""WITH RECURSIVE {SPECTRA_SQL}
        SELECT sample_id, layer, n_tokens, round(effective_rank, 6) AS effective_rank FROM ranks""",
    ),
    "rank_effective_rank": (
        scored("effective_rank", inner_layers, hidden_labels),
        f"""WITH RECURSIVE {SPECTRA_SQL},
        scores AS (
          SELECT sample_id, round(avg(effective_rank), 9) AS score FROM ranks WHERE layer >= 1 GROUP BY sample_id),
        labels_ AS (
          SELECT vec_id // 40 AS sample_id, CAST(min(label) AS BIGINT) AS label FROM embeddings GROUP BY 1)
        SELECT sample_id, label, score, row_number() OVER (ORDER BY score, sample_id) AS rank,
               'effective_rank' AS method FROM scores JOIN labels_ USING (sample_id)""",
    ),
    "rank_corr_integral": (
        scored("corr_integral", inner_layers, hidden_labels),
        CORR_INTEGRAL_SQL,
    ),
    "rank_entropy": (
        rank_entropy,
        f"""WITH {LOGITS},
        powers AS (
          SELECT vec_id, sample_id, label, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e
          FROM logits),
        tokens AS (
          SELECT sample_id, label,
                 list_sum(list_transform(e, lambda x: -(x / list_sum(e)) * ln(x / list_sum(e) + 1e-10::DOUBLE))) AS h
          FROM powers),
        scores AS (
          SELECT sample_id, min(label) AS label, CAST(round(avg(h), 6) AS FLOAT) AS score
          FROM tokens GROUP BY sample_id)
        {RANKED.format(method='llm_classifier')}""",
    ),
    "token_cap": (
        token_cap,
        f"WITH {HIDDEN_STATES} SELECT {SHAPE} FROM hidden_states WHERE token_pos < {CAP}",
    ),
    "last_layer_tokens": (
        last_layer_tokens,
        f"""WITH {HIDDEN_STATES} SELECT {SHAPE} FROM hidden_states WHERE layer >= 1
        QUALIFY layer = max(layer) OVER (PARTITION BY sample_id)""",
    ),
    "mean_pool": (
        mean_pool,
        f"""WITH {HIDDEN_STATES}, entries AS (
          SELECT sample_id, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS dim,
                 CAST(unnest(vector) AS DOUBLE) AS value FROM hidden_states)
        SELECT sample_id, dim, round(avg(value), 6) AS value FROM entries GROUP BY ALL""",
    ),
    "feature_map_points": (
        feature_map_points,
        """SELECT vec_id AS sample_id, CAST(k % 8 AS INTEGER) AS position,
               CAST(k // 8 AS INTEGER) AS channel, CAST(embedding[k + 1] AS DOUBLE) AS value
        FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings)""",
    ),
    "evaluate_predictions": (
        evaluate_predictions,
        f"""WITH {LOGITS},
        rows_ AS (
          SELECT run, epoch, list_position(logits, list_max(logits)) - 1 = label AS hit,
                 list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                   - logits[label + 1] AS loss
          FROM logits)
        SELECT run, epoch, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS accuracy,
               round(avg(loss), 6) AS loss
        FROM rows_ GROUP BY run, epoch""",
    ),
}
