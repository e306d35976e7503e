"""Scores from one feature vector per sample: redundancy, intrinsic dimension, density."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.functions import spectra
from chaffline.operators.neighbors import largest_similarity, nearest_distances
from chaffline.operators.positions import with_position
from chaffline.operators.selection import quantiles
from chaffline.operators.subspace import principal_axes, project
from chaffline.session import broadcast_if_small, cut_lineage

# Fixed values of the two-neighbour estimator and of the density score.
SHORTEST_DISTANCE = 1e-12
SMALLEST_RATIO = 1.0 + 1e-12
SMALLEST_DIMENSION = 1.0
DENSITY_NEIGHBOURS = 2
# Features up to which the covariance is held as a matrix.
NARROW = 2048


def redundancy_scores(features: DataFrame, digits: int = 6) -> DataFrame:
    """1 - largest cosine to another sample; 2 for a lone sample.

    Rounded before ranking: exact copies differ from 0 by noise that depends on the blocks.
    """
    similarity = F.coalesce("similarity", F.lit(-1.0))
    return largest_similarity(features).select(
        "sample_id", F.round(F.lit(1.0) - similarity, digits).alias("score")
    )


def knn_density(
    features: DataFrame, k: int = DENSITY_NEIGHBOURS, column: str = "features", digits: int = 6
) -> DataFrame:
    """(sample_id, score): mean distance to the k nearest other samples."""
    distances = nearest_distances(features, k, column)
    mean = F.aggregate("distances", F.lit(0.0), lambda acc, d: acc + d) / F.size("distances")
    return distances.select(
        "sample_id", F.round(F.when(F.size("distances") > 0, mean), digits).alias("score")
    )


def neighbour_ratios(features: DataFrame, column: str = "features") -> DataFrame:
    """(sample_id, ratio): second over first neighbour distance, with the floors of TwoNN."""
    floor = F.lit(SHORTEST_DISTANCE)
    r1 = F.greatest(F.get("distances", F.lit(0)), floor)
    r2 = F.greatest(F.get("distances", F.lit(1)), floor)
    return nearest_distances(features, 2, column).select(
        "sample_id", F.greatest(r2 / r1, F.lit(SMALLEST_RATIO)).alias("ratio")
    )


def twonn_dimension(features: DataFrame, column: str = "features") -> DataFrame:
    """One row: estimated dimension, and mean, median, smallest and largest ratio.

    The ratios get a global position, which gives both the empirical distribution and the
    median without bringing the values together.
    """
    placed = with_position(neighbour_ratios(features, column), ["ratio", "sample_id"])
    n = placed.count()
    if n < 3:
        raise ValueError("the two-neighbour estimate needs at least 3 samples")
    x = F.log("ratio")
    y = -F.log(F.lit(1.0) - (F.col("position") + 1) / F.lit(n + 1.0))
    middle = F.col("position").between((n - 1) // 2, n // 2)
    summary = placed.agg(
        F.sum(x * x).alias("_xx"),
        F.sum(x * y).alias("_xy"),
        F.avg("ratio").alias("mean_ratio"),
        F.avg(F.when(middle, F.col("ratio"))).alias("median_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
    )
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(
        F.raise_error(F.lit("the neighbour distance ratios are degenerate")).cast("double")
    )
    return summary.select(
        F.greatest(slope, F.lit(SMALLEST_DIMENSION)).alias("dimension"),
        "mean_ratio",
        "median_ratio",
        "min_ratio",
        "max_ratio",
    )


def reduce_features(features: DataFrame, dimension: float, column: str = "features") -> DataFrame:
    """(sample_id, reduced): principal components, floor(dimension) of them within the shape.

    Up to `NARROW` features the d x d covariance is the only thing that reaches the driver; beyond,
    the axes are found by block power steps. Components are not centred and their signs are free;
    neither changes distances between samples.
    """
    n, width = features.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    components = min(max(math.floor(dimension), 1), n, width)
    if width > NARROW:
        return project(features, principal_axes(features, components, column), column, "reduced")
    dense = features.select("sample_id", array_to_vector(F.col(column)).alias("_vector"))
    model = PCA(k=components, inputCol="_vector", outputCol="_reduced").fit(dense)
    return model.transform(dense).select(
        "sample_id", vector_to_array("_reduced", "float32").alias("reduced")
    )


def density_scores(features: DataFrame) -> DataFrame:
    """Neighbour density in the space of the estimated intrinsic dimension."""
    held = features.select("sample_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    dimension = twonn_dimension(held).first().dimension
    scores = cut_lineage(knn_density(reduce_features(held, dimension), column="reduced"))
    held.unpersist()
    return scores


def correlation_dimension(
    features: DataFrame, column: str = "features", neighbours: int = spectra.NEIGHBOURS
) -> DataFrame:
    """One row (dimension): correlation dimension of a whole table of points.

    Each point's `neighbours` nearest ones enter the correlation integral, which is part of the
    estimator.
    """
    spark = features.sparkSession
    n = features.count()

    def answer(value: float) -> DataFrame:
        return spark.createDataFrame([(float(value),)], "dimension double")

    if n < spectra.MIN_POINTS:
        return answer(spectra.DEFAULT_DIMENSION)
    k = min(neighbours, n - 1)
    distances = cut_lineage(nearest_distances(features, k, column).select("distances"))
    found = correlation_slopes(distances, n, []).first()
    return answer(found.dimension if found else spectra.DEFAULT_DIMENSION)


def _number_below(radius: Column) -> Column:
    return F.size(F.filter("distances", lambda d: d < radius))


def correlation_slopes(distances: DataFrame, n: int | Column, within: list[str]) -> DataFrame:
    """(*within, dimension) from the nearest distances of the points of each cloud.

    `distances` holds a row (*within, distances) for each point and is read a few times, never sorted:
    the two radii are selected by histograms, then each task counts what lies within the radii.
    `n` is the number of points of a cloud, or a column of `distances` with it.
    """
    values = distances.select(*within, F.explode("distances").alias("distance"))
    ends = quantiles(values, "distance", [spectra.LOW_QUANTILE, spectra.HIGH_QUANTILE], within)
    ends = cut_lineage(ends.select(*within, F.greatest("q0", F.lit(spectra.TINY)).alias("_low"), F.col("q1").alias("_high")))
    joined = distances.join(broadcast_if_small(ends), within) if within else distances.crossJoin(F.broadcast(ends))
    step = (F.log10("_high") - F.log10("_low")) / (spectra.RADII - 1)
    inner = [F.pow(F.lit(10.0), F.log10("_low") + step * i) for i in range(spectra.RADII)]
    counted = [F.coalesce(F.sum(_number_below(r)), F.lit(0)).alias(f"_c{i}") for i, r in enumerate(inner)]
    size = F.max(F.lit(n) if isinstance(n, int) else n).cast("double").alias("_n")
    counts = joined.groupBy(*within, "_low", "_high").agg(size, *counted)

    def slope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, size = (batch.column(c).to_numpy() for c in ("_low", "_high", "_n"))
            counts = np.array([batch.column(f"_c{i}").to_numpy() for i in range(spectra.RADII)], float).T
            found = [spectra.dimension_of_counts(*row) for row in zip(low, high, size, counts.reshape(-1, spectra.RADII))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in within), pa.array(found, pa.float64())], [*within, "dimension"]
            )

    schema = T.StructType([*(counts.schema[c] for c in within), T.StructField("dimension", T.DoubleType())])
    return counts.mapInArrow(slope, schema)
