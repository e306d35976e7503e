"""Evaluation grid: one training run per (method, budget, seed)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffline.functions.arrays import as_matrix
from chaffline.operators import logistic
from chaffline.operators.curves import RUN_SCHEMA
from chaffline.operators.subsets import retained_rows
from chaffline.session import cut_lineage

# Fixed value: smallest probability whose logarithm enters the loss.
SMALLEST_PROBABILITY = 1e-12


# Cumulated Poisson probabilities of mean 1; a seeded uniform number that passes k of
# them gives a row the weight k in the bootstrap sample of a seed.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
# (cell, class) pairs whose parameters are sent to the tasks at most.
GRID_CLASSES = 20_000
# Part of the largest variance that is added to all of them.
SMOOTHING = 1e-9
# Of the logistic model: penalty on squared weights, passes at most, and the slope that is flat enough.
PENALTY, PASSES, FLAT = 1e-2, 60, 1e-4


def _as_ml(frame: DataFrame) -> DataFrame:
    return frame.select(
        "sample_id",
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("features")).alias("features"),
    )


def _measure(model, frame: DataFrame) -> tuple[float, float]:
    """(accuracy, mean cross entropy) of a fitted model."""
    share = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    hit = (F.col("prediction") == F.col("label")).cast("int")
    loss = -F.log(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(SMALLEST_PROBABILITY)))
    row = model.transform(frame).agg(F.avg(hit), F.avg(loss)).first()
    nan = float("nan")
    return (nan if row[0] is None else row[0]), (nan if row[1] is None else row[1])


def bootstrap_weight(seed: Column, sample_id: Column) -> Column:
    """How often a seed's bootstrap sample has a row: Poisson of mean 1, by md5(seed|id)."""
    digest = F.md5(F.concat_ws("|", seed.cast("string"), sample_id.cast("string")))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return reduce(add, [(uniform >= p).cast("int") for p in POISSON])


_CELL = ["method", "percent_removed", "seed"]


def _bayes_grid(train, validation, subsets, seeds, test) -> DataFrame:
    spark = train.sparkSession
    width = train.agg(F.max(F.size("features"))).first()[0] or 0
    members = (
        subsets.select("method", "percent_removed", "sample_id")
        .join(train.select("sample_id", "label", "features"), "sample_id")
        .withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))
        .withColumn("w", bootstrap_weight(F.col("seed"), F.col("sample_id")).cast("double"))
        .where("w > 0")
    )
    values = [F.get("features", F.lit(i)).cast("double") for i in range(width)]
    # One row per cell and class: the cells of a grid times the classes.
    params = cut_lineage(
        members.groupBy(*_CELL, F.col("label").cast("long").alias("label")).agg(
            F.sum("w").alias("n"),
            F.array(*[F.sum(F.col("w") * v) for v in values]).alias("sums"),
            F.array(*[F.sum(F.col("w") * v * v) for v in values]).alias("squares"),
        )
    )
    if params.limit(GRID_CLASSES + 1).count() > GRID_CLASSES:
        raise ValueError(f"more than {GRID_CLASSES} (cell, class) pairs: give an estimator instead")
    shared = spark.sparkContext.broadcast(_cells(params.collect()))
    return _measured_cells(shared, _bayes_logs, validation, test)


def _members(train: DataFrame, subsets: DataFrame, seeds: Sequence[int]) -> tuple[DataFrame, list[tuple]]:
    """Rows (sample_id, label, features, cells, weights), and the cells in the order of their numbers."""
    names = subsets.select("method", "percent_removed").distinct().collect()  # a row per method and budget
    cells = sorted((r[0], r[1], int(s)) for r in names for s in seeds)
    numbers = train.sparkSession.createDataFrame(
        [(i, *c) for i, c in enumerate(cells)], "cell int, method string, percent_removed int, seed long"
    )
    own = (
        subsets.select("method", "percent_removed", "sample_id")
        .join(F.broadcast(numbers), ["method", "percent_removed"])
        .withColumn("w", bootstrap_weight(F.col("seed"), F.col("sample_id")).cast("double"))
        .where("w > 0")
        .groupBy("sample_id")
        .agg(F.sort_array(F.collect_list(F.struct("cell", "w"))).alias("own"))  # a cell each at most
    )
    return train.select("sample_id", "label", "features").join(own, "sample_id").select(
        "sample_id", "label", "features", F.col("own.cell").alias("cells"), F.col("own.w").alias("weights")
    ), cells


def _logistic_grid(train, validation, subsets, seeds, test) -> DataFrame:
    spark = train.sparkSession
    members, cells = _members(train, subsets, seeds)
    width = train.agg(F.max(F.size("features"))).first()[0] or 0
    values = [F.get("features", F.lit(i)).cast("double") for i in range(width)]
    centre, spread = train.agg(
        F.array(*[F.avg(v) for v in values]), F.array(*[F.stddev_pop(v) for v in values])
    ).first()
    classes = np.sort(np.array([r[0] for r in train.select(F.col("label").cast("long")).distinct().limit(GRID_CLASSES + 1).collect()]))
    if len(cells) * len(classes) > GRID_CLASSES:
        raise ValueError(f"more than {GRID_CLASSES} (cell, class) pairs: give an estimator instead")
    centre, spread = np.array(centre, float), np.array(spread, float)
    spread[~(spread > 0)] = 1.0
    scaled = F.transform(
        "features", lambda x, i: (x.cast("double") - F.get(F.lit(centre.tolist()), i)) / F.get(F.lit(spread.tolist()), i)
    )
    number = F.array_position(F.lit(classes.tolist()), F.col("label").cast("long")).cast("int") - 1
    rows = cut_lineage(
        members.select(F.concat(scaled, F.array(F.lit(1.0))).alias("features"), number.alias("class"), "cells", "weights")
    )
    weights, _ = logistic.fit_cells(rows, len(cells), len(classes), width + 1, PENALTY, PASSES, FLAT)
    models = [(classes, centre, spread, w) for w in weights]
    return _measured_cells(spark.sparkContext.broadcast((cells, models)), _logistic_logs, validation, test)


def _logistic_logs(rows: np.ndarray, model: tuple) -> np.ndarray:
    _, centre, spread, weights = model
    inner = np.concatenate([(rows - centre) / spread, np.ones((len(rows), 1))], axis=1)
    return logistic.log_chances(inner, weights[None])[:, 0]


def _bayes_logs(rows: np.ndarray, model: tuple) -> np.ndarray:
    _, prior, means, variance = model
    return np.stack(
        [p - 0.5 * ((rows - m) ** 2 / v + np.log(2 * np.pi * v)).sum(1) for p, m, v in zip(prior, means, variance)], 1
    )


def _measured_cells(shared, logs, validation: DataFrame, test: DataFrame | None) -> DataFrame:
    """Run results of the cells' models; `logs` gives the classes' logarithms for rows and a model."""
    spark = validation.sparkSession
    measured = _measure_cells(validation, shared, logs, "val")
    if test is not None:
        measured = measured.unionByName(_measure_cells(test, shared, logs, "test"))
    of = lambda kind, part: F.sum(F.when(F.col("kind") == kind, F.col(part)))
    mean = lambda kind, part: F.coalesce(of(kind, part) / of(kind, "n"), F.lit(float("nan")))
    found = measured.groupBy("cell").agg(
        mean("val", "hits").alias("best_val_acc"),
        mean("val", "loss").alias("best_val_loss"),
        mean("test", "hits").alias("test_acc"),
    )
    names = spark.createDataFrame(
        [(i, *cell) for i, cell in enumerate(shared.value[0])],
        "cell int, method string, percent_removed int, seed long",
    )
    measures = ("best_val_acc", "best_val_loss", "test_acc")
    # A cell without a measure has NaN; the columns stay nullable, as runs are stored.
    measured = [F.when(F.col("cell") >= 0, F.coalesce(c, F.lit(float("nan")))).alias(c) for c in measures]
    return names.join(found, "cell", "left").select(*_CELL, *measured)


def _cells(rows: list) -> tuple[list, list]:
    """Cells in order, and for each its classes, log priors, means and variances."""
    by_cell: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (*(r[c] for c in _CELL), r["label"])):
        by_cell.setdefault(tuple(r[c] for c in _CELL), []).append(r)
    models = []
    for own in by_cell.values():
        n = np.array([r["n"] for r in own])[:, None]
        sums, squares = (np.array([r[c] for r in own], dtype=float) for c in ("sums", "squares"))
        spread = squares.sum(0) / n.sum() - (sums.sum(0) / n.sum()) ** 2
        variance = squares / n - (sums / n) ** 2 + SMOOTHING * spread.max(initial=0.0)
        models.append((np.array([r["label"] for r in own]), np.log(n[:, 0] / n.sum()), sums / n, variance))
    return list(by_cell), models


def _measure_cells(frame: DataFrame, shared, logs_of, kind: str) -> DataFrame:
    """(cell, kind, n, hits, loss): sums over a partition's rows, for every cell."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value[1]
        total = np.zeros((len(models), 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, rows = np.asarray(batch.column("label")), as_matrix(batch.column("features"))
            for i, model in enumerate(models):
                classes, logs = model[0], logs_of(rows, model)
                top = logs.max(1, keepdims=True)
                shares = np.exp(logs - top)
                shares /= shares.sum(1, keepdims=True)
                right = classes[None, :] == labels[:, None]
                share = (shares * right).sum(1)
                hits = classes[logs.argmax(1)] == labels
                loss = -np.log(np.maximum(share, SMALLEST_PROBABILITY))
                total[i] += (len(labels), hits.sum(), loss.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(models)), pa.int32()),
                pa.array([kind] * len(models), pa.string()),
                *(pa.array(total[:, j]) for j in range(3)),
            ],
            names=["cell", "kind", "n", "hits", "loss"],
        )

    rows = frame.select(F.col("label").cast("long").alias("label"), F.col("features").cast("array<double>").alias("features"))
    return rows.mapInArrow(measure, "cell int, kind string, n double, hits double, loss double")


def evaluation_grid(
    train: DataFrame,
    validation: DataFrame,
    subsets: DataFrame,
    seeds: Sequence[int],
    estimator: Callable[[int], Estimator] | None = None,
    test: DataFrame | None = None,
    parallelism: int = 4,
    model: str = "bayes",
) -> DataFrame:
    """Run results: a model fitted on each subset and measured on the validation rows.

    `train`, `validation` and `test` hold (sample_id, label, features), `subsets` what
    `build_subsets` returns. Without test rows `test_acc` is NaN.

    The default model is Gaussian naive Bayes, fitted for all cells at once: one aggregate over the
    retained rows, in which every seed weighs them by its own bootstrap sample, and one pass
    over the rows that are measured, however many cells there are. `model="logistic"` fits multinomial
    logistic regressions instead, of scaled features and with a small penalty, from the same bootstrap
    samples: each pass over the rows takes a step in all cells. With an `estimator` (seed to
    Spark ML estimator) the loop runs over the cells of the grid, a few at a time.
    """
    if estimator is None:
        fitted = {"bayes": _bayes_grid, "logistic": _logistic_grid}[model]
        return fitted(train, validation, subsets, seeds, test)
    rows = _as_ml(train).persist()
    held = _as_ml(validation).persist()
    final = _as_ml(test).persist() if test is not None else None
    cells = subsets.select("method", "percent_removed").distinct().collect()
    grid = [(c[0], c[1], seed) for c in cells for seed in seeds]

    def run(cell: tuple[str, int, int]) -> tuple:
        method, percent, seed = cell
        ids = subsets.filter((F.col("method") == method) & (F.col("percent_removed") == percent))
        model = estimator(seed).fit(retained_rows(rows, ids))
        accuracy, loss = _measure(model, held)
        test_accuracy = _measure(model, final)[0] if final is not None else float("nan")
        return method, percent, seed, accuracy, loss, test_accuracy

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        runs = sorted(pool.map(inheritable_thread_target(train.sparkSession)(run), grid))
    for frame in (rows, held, final):
        if frame is not None:
            frame.unpersist()
    return train.sparkSession.createDataFrame(runs, RUN_SCHEMA)
