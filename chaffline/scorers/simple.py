"""Scorers that need no model: a seeded order and the character quality of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.functions.keys import row_count, seeded_key
from chaffline.functions.text import character_quality
from chaffline.operators.positions import with_position
from chaffline.scorers.base import carried


def random_scores(samples: DataFrame, seed: int = 777) -> DataFrame:
    """A seeded permutation, its position scaled to 0..1."""
    held = carried(samples)
    keyed = samples.select("sample_id", *held, seeded_key(seed, "sample_id").alias("_key"))
    placed = with_position(keyed, ["_key", "sample_id"])
    last = F.greatest(row_count(placed) - 1, F.lit(1))
    return placed.select("sample_id", *held, (F.col("position") / last).alias("score"))


def heuristic_scores(samples: DataFrame) -> DataFrame:
    """Character quality of each text; one projection over the scan."""
    score = character_quality(F.col("text")).alias("score")
    return samples.select("sample_id", *carried(samples), score)
