"""Scores from hidden states (sample_id, layer, token_pos, vector): one matrix per layer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffline.functions import spectra
from chaffline.functions.arrays import as_matrix
from chaffline.functions.keys import seeded_key
from chaffline.operators.neighbors import nearest_within
from chaffline.scorers.geometry import correlation_slopes
from chaffline.session import broadcast_if_small, cut_lineage

# Points of a layer up to which one task measures it.
LAYER_POINTS = 4096
# Seed of the draw of points, where one is asked for.
POINTS_SEED = 0
# Rows of a layer's factors that meet in one group before they are reduced again.
SALTS = 32

# Values a partition gathers for all its layers at most before it gives their factors out.
HELD_VALUES = 16 << 20

_PART = "sample_id long, layer int, n_tokens long, vector array<double>"


def _compress_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each layer's rows in a partition by fewer rows with the same singular values.

    A layer's rows gather until they are twice as many as its columns, then become their triangular
    factor; so a layer leaves a partition with as many rows as its vectors have entries at most.
    """
    held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for batch in batches:
        samples = batch.column("sample_id").to_numpy()
        layers = batch.column("layer").to_numpy()
        counts = batch.column("n_tokens").to_numpy()
        order = np.lexsort((layers, samples))
        samples, layers, counts = samples[order], layers[order], counts[order]
        new = np.flatnonzero((np.diff(samples) != 0) | (np.diff(layers) != 0)) + 1
        edges = np.concatenate([[0], new, [len(order)]]) if len(order) else np.zeros(1, int)
        matrix = as_matrix(batch.column("vector"))[order]
        for start, stop in zip(edges[:-1], edges[1:]):
            key = int(samples[start]), int(layers[start])
            tokens, rows = held.pop(key, (0, matrix[:0]))
            rows = np.concatenate([rows, matrix[start:stop]])
            if len(rows) >= 2 * rows.shape[1]:
                rows = spectra.compress_rows(rows)
            held[key] = tokens + int(counts[start:stop].sum()), rows
        if sum(rows.size for _, rows in held.values()) > HELD_VALUES:
            yield _factors(held)
            held = {}
    yield _factors(held)


def _factors(held: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch:
    ids, which, counts, vectors = [], [], [], []
    for (sample, layer), (tokens, rows) in held.items():
        part = spectra.compress_rows(rows)
        ids += [sample] * len(part)
        which += [layer] * len(part)
        # The first row carries the number of rows it stands for.
        counts += [tokens] + [0] * (len(part) - 1)
        vectors.extend(part)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(which, pa.int32()),
            pa.array(counts, pa.int64()),
            pa.array(vectors, pa.list_(pa.float64())),
        ],
        names=["sample_id", "layer", "n_tokens", "vector"],
    )


def _layer_rank(layer: pa.Table) -> pa.Table:
    tokens = int(np.sum(layer.column("n_tokens").to_numpy()))
    if tokens < 2:
        raise ValueError("the effective rank needs at least 2 token vectors in a layer")
    value = spectra.effective_rank(as_matrix(layer.column("vector")))
    return pa.table(
        {
            "sample_id": [layer.column("sample_id")[0].as_py()],
            "layer": pa.array([layer.column("layer")[0].as_py()], pa.int32()),
            "n_tokens": [tokens],
            "effective_rank": [value],
        }
    )


def effective_rank_layers(hidden: DataFrame) -> DataFrame:
    """(sample_id, layer, n_tokens, effective_rank).

    Long layers shrink before the shuffle: a partition's rows of a layer are replaced by the
    triangular factor of their QR decomposition, which has as many rows as the vectors have
    entries. The factors of a layer then meet in two steps: those of some partitions first,
    reduced again, then what is left of those.
    """
    rows = hidden.select(
        F.col("sample_id").cast("long").alias("sample_id"),
        F.col("layer").cast("int").alias("layer"),
        F.lit(1).cast("long").alias("n_tokens"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    parts = rows.mapInArrow(_compress_batches, _PART)
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    fewer = salted.repartition("sample_id", "layer", "_salt").drop("_salt").mapInArrow(_compress_batches, _PART)
    return (
        fewer.groupBy("sample_id", "layer")
        .applyInArrow(
            _layer_rank, "sample_id long, layer int, n_tokens long, effective_rank double"
        )
    )


def effective_rank_scores(hidden: DataFrame, digits: int = 9) -> DataFrame:
    """Mean effective rank over the layers of each sample."""
    return (
        effective_rank_layers(hidden)
        .groupBy("sample_id")
        .agg(F.round(F.avg("effective_rank"), digits).alias("score"))
    )


def _layer_dimension(neighbours: int):
    def dimension(layer: pa.Table) -> pa.Table:
        points = as_matrix(layer.column("vector"))
        usable = len(points) >= spectra.MIN_POINTS
        found = [spectra.correlation_dimension(points, neighbours)] * usable
        return pa.table(
            {"sample_id": layer.column("sample_id")[: int(usable)], "dimension": pa.array(found, pa.float64())}
        )

    return dimension


def correlation_scores(
    hidden: DataFrame,
    max_points: int | None = None,
    digits: int = 9,
    neighbours: int = spectra.NEIGHBOURS,
) -> DataFrame:
    """Mean correlation dimension over the layers with enough points; 1 if there are none.

    All points of a layer count; `max_points` asks for a seeded draw of at most so many. Each
    point's `neighbours` nearest ones enter the correlation integral, which is part of the
    estimator. A layer of up to `LAYER_POINTS` points is measured by one task; of a larger one
    blocks of points are compared pair by pair, its quantiles are selected by histograms and its
    counts are added up, so that it takes all cores and is held by none.
    """
    rows = hidden
    if max_points is not None:
        group = Window.partitionBy("sample_id", "layer")
        key = seeded_key(POINTS_SEED, "sample_id", "layer", "token_pos")
        rows = (
            hidden.withColumn("_key", key)
            .withColumn("_draw", F.row_number().over(group.orderBy("_key", "token_pos")))
            .filter(F.col("_draw") <= max_points)
        )
    points = rows.select(
        F.col("sample_id").cast("long").alias("sample_id"),
        "layer",
        F.col("vector").cast("array<double>").alias("vector"),
    )
    layer = ["sample_id", "layer"]
    sizes = points.groupBy(*layer).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.where(F.col("_n") > LAYER_POINTS))
    if large.isEmpty():
        small = points
    else:
        hinted = broadcast_if_small(large)
        small = points.join(hinted, layer, "left_anti")
    dimensions = small.groupBy(*layer).applyInArrow(_layer_dimension(neighbours), "sample_id long, dimension double")
    if not large.isEmpty():
        long_layers = _long_dimensions(points.join(hinted, layer), neighbours)
        dimensions = dimensions.unionByName(long_layers)
    ids = hidden.select(F.col("sample_id").cast("long").alias("sample_id")).distinct()
    means = dimensions.groupBy("sample_id").agg(F.avg("dimension").alias("_mean"))
    default = F.lit(spectra.DEFAULT_DIMENSION)
    return ids.join(means, "sample_id", "left").select(
        "sample_id", F.round(F.coalesce("_mean", default), digits).alias("score")
    )


def _long_dimensions(points: DataFrame, neighbours: int) -> DataFrame:
    """(sample_id, dimension) of layers (sample_id, layer, vector, _n) of any size."""
    named = points.select(
        F.col("sample_id").alias("_sample"), F.col("layer").alias("_layer"), "_n", "vector",
        F.monotonically_increasing_id().alias("sample_id"),
    )
    written = cut_lineage(named)  # a point's number must stay its own
    keys = ["_sample", "_layer", "_n"]
    near = cut_lineage(nearest_within(written, neighbours, keys).drop("sample_id"))
    found = correlation_slopes(near, F.col("_n"), ["_sample", "_layer"])
    return found.select(F.col("_sample").alias("sample_id"), "dimension")
