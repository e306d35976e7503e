"""Measures of one small matrix, used inside grouped tasks."""

from __future__ import annotations

import numpy as np

# Nearest neighbours of a point that enter the correlation integral unless told otherwise.
NEIGHBOURS = 50
# Fixed values of the two measures.
TINY = 1e-12
RADII = 20
ROWS_AT_ONCE = 512
LOW_QUANTILE = 0.02
HIGH_QUANTILE = 0.90
MIN_POINTS = 5
DEFAULT_DIMENSION = 1.0
SMALLEST_DIMENSION = 0.1


def compress_rows(matrix: np.ndarray) -> np.ndarray:
    """A matrix with the same singular values and at most as many rows as columns."""
    rows, columns = matrix.shape
    return np.linalg.qr(matrix, mode="r") if rows > columns else matrix


def singular_values(matrix: np.ndarray) -> np.ndarray:
    """Of a matrix or of its triangular factor, which has the same ones."""
    return np.linalg.svd(compress_rows(matrix), compute_uv=False)


def effective_rank(factor: np.ndarray) -> float:
    """exp of the entropy of the singular values scaled to sum 1; 1 for a zero matrix."""
    spectrum = singular_values(np.asarray(factor, dtype=np.float64))
    if spectrum.sum() < TINY:
        return 1.0
    weights = spectrum / spectrum.sum()
    surprise = -np.log(np.maximum(weights, TINY))
    return float(np.exp(weights @ surprise))


def neighbour_distances(points: np.ndarray, k: int) -> np.ndarray:
    """(n, k) Euclidean distances to the k nearest other points, ascending.

    A block of rows is compared with all points at a time, so memory grows with n and not with n * n.
    """
    centred = points - points.mean(axis=0)
    squares = (centred**2).sum(axis=1)
    found = np.empty((len(points), k))
    for start in range(0, len(points), ROWS_AT_ONCE):
        rows = slice(start, start + ROWS_AT_ONCE)
        gaps = squares[rows, None] + squares[None, :] - 2.0 * (centred[rows] @ centred.T)
        own = np.arange(len(gaps))
        gaps[own, start + own] = np.inf
        found[rows] = np.sort(np.partition(gaps, k - 1, axis=1)[:, :k], axis=1)
    return np.sqrt(np.clip(found, 0.0, None))


def slope_of_middle(x: np.ndarray, y: np.ndarray) -> float:
    """Least-squares slope over the middle 60% of the points, over all if that leaves under 3."""
    margin = len(x) // 5
    if len(x) - 2 * margin >= 3:
        x, y = x[margin : len(x) - margin], y[margin : len(y) - margin]
    dx = x - x.mean()
    return float(dx @ (y - y.mean()) / (dx @ dx))


def correlation_dimension(points: np.ndarray, neighbours: int = NEIGHBOURS) -> float:
    """Slope of the log correlation integral against the log radius."""
    cloud = np.asarray(points, dtype=np.float64)
    n = len(cloud)
    if n < MIN_POINTS:
        return DEFAULT_DIMENSION
    distances = neighbour_distances(cloud, min(neighbours, n - 1)).ravel()
    low, high = np.quantile(distances, [LOW_QUANTILE, HIGH_QUANTILE])
    low = max(low, TINY)
    if high <= low:
        return DEFAULT_DIMENSION
    radii = np.logspace(np.log10(low), np.log10(high), RADII)
    return dimension_of_counts(low, high, n, np.searchsorted(np.sort(distances), radii, side="left"))


def dimension_of_counts(low: float, high: float, n: float, counts: np.ndarray) -> float:
    """The dimension from how many distances of n points lie within each of the radii from low to high."""
    if high <= low:
        return DEFAULT_DIMENSION
    radii = np.logspace(np.log10(low), np.log10(high), RADII)
    within = counts / n / (n - 1)
    seen = within > TINY
    if seen.sum() < 3:
        return DEFAULT_DIMENSION
    return max(slope_of_middle(np.log(radii[seen]), np.log(within[seen])), SMALLEST_DIMENSION)
