"""Metrics of training runs: best epochs and the evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.functions import vectors
from chaffline.functions.numeric import nan_to_null


def best_epoch(metrics: DataFrame, run: str = "run", order: str = "epoch") -> DataFrame:
    """(run, best_val_acc, best_val_loss): the row with the highest validation accuracy.

    The loss is that row's own; the first such row counts. Rows without accuracy are left out,
    a run of only such rows gives NaN twice.
    """
    accuracy = nan_to_null("val_acc")
    row = F.struct(accuracy.alias("acc"), nan_to_null("val_loss").alias("loss"))
    place = F.when(accuracy.isNotNull(), F.struct(accuracy, -F.col(order)))
    nan = F.lit(float("nan"))
    return (
        metrics.groupBy(run)
        .agg(F.max_by(F.when(accuracy.isNotNull(), row), place).alias("_best"))
        .select(
            run,
            F.coalesce("_best.acc", nan).alias("best_val_acc"),
            F.coalesce("_best.loss", nan).alias("best_val_loss"),
        )
    )


def best_val_loss(metrics: DataFrame, run: str = "run") -> DataFrame:
    """(run, best_val_loss): the smallest validation loss, NaN where there is none."""
    return metrics.groupBy(run).agg(
        F.coalesce(F.min(nan_to_null("val_loss")), F.lit(float("nan"))).alias("best_val_loss")
    )


def evaluate_predictions(logits: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, accuracy, loss): share of right predictions and mean cross entropy.

    `label` is the 0-based class; the first largest logit is the prediction.
    """
    hit = (vectors.argmax(F.col("logits")) == F.col("label")).cast("int")
    own = F.get("logits", F.col("label").cast("int")).cast("double")
    return (
        logits.select(
            *keys, hit.alias("_hit"), (vectors.log_sum_exp(F.col("logits")) - own).alias("_loss")
        )
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("_hit").alias("accuracy"),
            F.avg("_loss").alias("loss"),
        )
    )
