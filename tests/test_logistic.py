import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chaffline.operators import grid, logistic
from chaffline.operators.grid import bootstrap_weight, evaluation_grid


def data(spark, n=240):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(4)[y][:, :4] * 1.5
    rows = [(i, int(label), [float(v) for v in own]) for i, (label, own) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "sample_id long, label int, features array<double>").repartition(4)


def subsets_of(train, budgets):
    return train.select("sample_id").withColumn("percent_removed", F.explode(F.array(*map(F.lit, budgets)))).where(
        "sample_id % 100 >= percent_removed"
    ).select(F.lit("m").alias("method"), "percent_removed", "sample_id")


def test_all_cells_equal_single_fits(spark, monkeypatch):
    """Every cell's measures are those of a model fitted to its bootstrap sample alone."""
    rows = data(spark)
    train, validation = rows.where("sample_id < 180"), rows.where("sample_id >= 180")
    subsets, seeds = subsets_of(train, [0, 40]), [1, 2]
    monkeypatch.setattr(grid, "FLAT", 1e-7)
    found = {(r.percent_removed, r.seed): r for r in evaluation_grid(train, validation, subsets, seeds, model="logistic").collect()}
    assert set(found) == {(p, s) for p in (0, 40) for s in seeds}
    row = train.agg(*[F.avg(F.col("features")[i]) for i in range(4)], *[F.stddev_pop(F.col("features")[i]) for i in range(4)]).first()
    scaled = F.array(*[(F.col("features")[i] - row[i]) / row[4 + i] for i in range(4)])
    frame = lambda f: f.withColumn("x", array_to_vector(scaled)).withColumn("y", F.col("label").cast("double"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=grid.PENALTY, standardization=False, maxIter=200, tol=1e-12)
    own = frame(train.join(subsets.where("percent_removed = 40"), "sample_id")).withColumn("w", bootstrap_weight(F.lit(2), F.col("sample_id")).cast("double"))
    accuracy, loss = grid._measure(model.fit(own.where("w > 0")), frame(validation).withColumn("label", F.col("y")))
    cell = found[40, 2]
    assert cell.best_val_loss == pytest.approx(loss, rel=1e-4)
    assert cell.best_val_acc == pytest.approx(accuracy, abs=0.02)


def test_passes_do_not_grow_with_cells(spark):
    rows = data(spark, 120)
    used = []
    for seeds in ([1], [1, 2, 3, 4]):
        members, cells = grid._members(rows, subsets_of(rows, [0, 30]), seeds)
        ready = members.select(F.concat("features", F.array(F.lit(1.0))).alias("features"), F.col("label").alias("class"), "cells", "weights").persist()
        weights, passes = logistic.fit_cells(ready, len(cells), 3, 5, 1e-2, 60, 1e-3)
        assert weights.shape == (2 * len(seeds), 3, 5)
        used.append(passes)
    assert used[1] <= used[0] + 8 and max(used) < 40


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    rows, own, share = rng.normal(size=(30, 3)), rng.integers(0, 2, 30), rng.integers(0, 3, (30, 4)).astype(float)
    weights = rng.normal(size=(4, 2, 3))
    value, gradient = logistic.losses(rows, own, share, weights)
    for cell, k, j in ((0, 0, 0), (3, 1, 2)):
        moved = weights.copy()
        moved[cell, k, j] += 1e-6
        assert (logistic.losses(rows, own, share, moved)[0] - value)[cell] / 1e-6 == pytest.approx(gradient[cell, k, j], rel=1e-3)
