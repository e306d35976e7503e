"""Reproducible train/validation splits: (sample_id, split)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffline.functions.keys import row_count, seeded_key
from chaffline.operators.positions import with_position
from chaffline.session import broadcast_if_small, cut_lineage

TRAIN = "train"
VALIDATION = "val"


def random_split(ids: DataFrame, val_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """max(1, floor(n * fraction)) samples, first by seeded key, go to validation."""
    placed = with_position(
        ids.select("sample_id", seeded_key(seed, "sample_id").alias("_key")), ["_key", "sample_id"]
    )
    size = F.greatest(F.lit(1), F.floor(row_count(placed) * F.lit(val_fraction)))
    return placed.select(
        "sample_id",
        F.when(F.col("position") < size, VALIDATION).otherwise(TRAIN).alias("split"),
    )


def stratified_split(labels: DataFrame, val_size: int, seed: int = 42) -> DataFrame:
    """A split of exactly `val_size` validation samples, spread over the classes.

    Every class gives its half-even rounded share, at least one sample and, where it has two or
    more, not all of them. Both lists run in class order; a surplus moves back from the end of
    the validation list, a shortage is taken from the end of the train list.
    """
    keyed = labels.select("sample_id", "label", seeded_key(seed, "sample_id").alias("_key"))
    placed = with_position(keyed, ["_key", "sample_id"], within=["label"])
    classes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))

    whole = classes.agg(F.sum("n_class")).first()[0] or 0
    if not 1 <= val_size <= whole - 1:
        raise ValueError(f"val_size must lie in [1, {whole - 1}], not {val_size}")

    share = F.bround(F.col("n_class") * val_size / F.lit(whole)).cast("long")
    earlier = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        classes.withColumn(
            "quota", F.greatest(F.lit(1), F.least(share, F.col("n_class") - 1))
        )
        .withColumn("val_start", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))
        .withColumn(
            "train_start", F.coalesce(F.sum(F.col("n_class") - F.col("quota")).over(earlier), F.lit(0))
        )
    )
    quotas = cut_lineage(quotas)
    chosen = quotas.agg(F.sum("quota")).first()[0]
    missing = max(val_size - chosen, 0)

    listed_val = F.col("position") < F.col("quota")
    val_place = F.col("val_start") + F.col("position")
    train_place = F.col("train_start") + F.col("position") - F.col("quota")
    in_validation = F.when(listed_val, val_place < val_size).otherwise(
        train_place >= whole - chosen - missing
    )
    return placed.join(broadcast_if_small(quotas), "label").select(
        "sample_id", F.when(in_validation, VALIDATION).otherwise(TRAIN).alias("split")
    )
