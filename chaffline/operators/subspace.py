"""Principal axes of wide tables by block power steps: no matrix of features by features anywhere.

A random block of a few more directions than wanted is multiplied by the centred covariance and made
orthogonal again, a pass over the rows each time. A task keeps one product of its rows with the block
and sends a row per direction; these are added up in two steps, and only the block (features x
directions) reaches the driver. A last small eigenproblem inside the block gives the axes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.functions.arrays import as_matrix

#: Directions beyond those wanted, passes at most, and the change of the variances that ends them.
EXTRA, PASSES, SETTLED = 10, 30, 1e-10
#: Groups in which the tasks' sums meet first.
SALTS = 32
#: Values of the block that are sent to all tasks at most.
BLOCK_VALUES = 64 << 20
SEED = 0

_SUM = "part int, total binary"


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(t, np.float64) for t in group["total"].to_pylist()], axis=0)
    return pa.table({"part": group["part"][:1], "total": [total.tobytes()]})


def sum_of_rows(rows: DataFrame, product, parts: int) -> np.ndarray:
    """The sum over batches of matrices (parts, n) that `product` makes of each batch's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = product(as_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(parts), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["part", "total"]
            )

    sums = rows.mapInArrow(run, _SUM).groupBy("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    found = sums.applyInArrow(_added, _SUM).groupBy("part").applyInArrow(_added, _SUM).orderBy("part").toArrow()
    return np.array([np.frombuffer(t, np.float64) for t in found["total"].to_pylist()])


def principal_axes(features: DataFrame, count: int, column: str = "features") -> np.ndarray:
    """(width, count): the directions of largest variance, in their order; signs are free.

    `features` is read once a pass and should be written. All vectors must have one width, which is
    bounded only by the block: width x (count + EXTRA) values.
    """
    rows = features.select(F.col(column).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = min(count + EXTRA, width, n)
    if width * size > BLOCK_VALUES:
        raise ValueError(f"{width} features x {size} directions are more than {BLOCK_VALUES} values")
    mean = sum_of_rows(rows, lambda m: m.sum(0, keepdims=True), 1)[0] / n
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, size)))[0]
    before = np.zeros(size)
    for _ in range(PASSES):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def product(matrix: np.ndarray) -> np.ndarray:
            centred = matrix - mean
            return (centred.T @ (centred @ sent.value)).T

        image = sum_of_rows(rows, product, size).T
        inner = block.T @ image
        variances, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-variances)
        variances, axes = variances[order], block @ turn[:, order]
        wanted = variances[:count]
        if np.abs(wanted - before[:count]).max() <= SETTLED * max(wanted.max(), 1e-300):
            break
        before = variances
        block = np.linalg.qr(image)[0]
    return axes[:, :count]


def project(features: DataFrame, axes: np.ndarray, column: str, name: str) -> DataFrame:
    """(sample_id, name): each vector's coordinates along the axes, in single precision."""
    sent = features.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = (as_matrix(batch.column(1)) @ sent.value).astype(np.float32)
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["sample_id", name])

    rows = features.select(F.col("sample_id").cast("long").alias("sample_id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"sample_id long, {name} array<float>")
