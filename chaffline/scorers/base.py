"""The scorer contract: a table in, a ranking out.

A scorer turns its input table into (sample_id, score); this module adds the label, the rank
and the method name. Labels may come with the input or from a narrow table of their own, which
is joined after scoring so that wide inputs are not shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.functions.numeric import as_score
from chaffline.operators.positions import with_rank

RANKING_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("label", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.LongType()),
        T.StructField("method", T.StringType()),
    ]
)

# What a scorer reads.
SAMPLES = "samples"
TEXT = "text"
FEATURES = "features"
HIDDEN_STATES = "hidden_states"
TOKEN_LOSSES = "token_losses"
TOKEN_DISTRIBUTIONS = "token_distributions"
PREDICTION_LOG = "prediction_log"


@dataclass(frozen=True)
class Scorer:
    """A named scoring method.

    `compute(frame, **options)` returns (sample_id, score), and the label where it can carry it
    along. `single_precision` scores are held
    as float32 before ranking; the two spectral methods keep doubles and rank from 1.
    """

    name: str
    reads: str
    required: tuple[str, ...]
    compute: Callable[..., DataFrame]
    options: dict[str, Any] = field(default_factory=dict)
    single_precision: bool = True
    rank_base: int = 0

    def check(self, frame: DataFrame) -> None:
        missing = [c for c in self.required if c not in frame.columns]
        if missing:
            raise ValueError(f"{self.name} needs column(s) {', '.join(missing)}")

    def scores(self, frame: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """(sample_id, label, score, method) without the rank."""
        self.check(frame)
        if labels is None and "label" not in frame.columns:
            raise ValueError(f"{self.name} needs a label column or a labels table")
        computed = self.compute(frame, **self.options)
        score = as_score(F.col("score")) if self.single_precision else F.col("score")
        computed = computed.withColumn("score", score)
        if "label" not in computed.columns:
            # One label per id, the smallest, so that no sample is ranked twice.
            known = frame if labels is None else labels
            found = known.groupBy("sample_id").agg(F.min("label").alias("label"))
            computed = computed.join(found, "sample_id", "left")
        return computed.select(
            F.col("sample_id").cast("long").alias("sample_id"),
            F.col("label").cast("long").alias("label"),
            "score",
            F.lit(self.name).alias("method"),
        )

    def score(self, frame: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """The ranking: (sample_id, label, score, rank, method), in no particular row order."""
        ranked = with_rank(
            self.scores(frame, labels).select("sample_id", "label", "score"), base=self.rank_base
        )
        return ranked.withColumn("method", F.lit(self.name)).select(*RANKING_SCHEMA.names)


def carried(frame: DataFrame) -> list[str]:
    """The label column, if the input has one."""
    return ["label"] if "label" in frame.columns else []


def rank_together(scored: list[DataFrame], bases: dict[str, int] | None = None) -> DataFrame:
    """One long ranking table from the scores of several methods, ranked per method at once."""
    union = scored[0]
    for other in scored[1:]:
        union = union.unionByName(other)
    ranked = with_rank(union, within=["method"])
    for method, base in (bases or {}).items():
        if base:
            ranked = ranked.withColumn(
                "rank", F.col("rank") + F.when(F.col("method") == method, base).otherwise(0)
            )
    return ranked.select(*RANKING_SCHEMA.names)


def score_summary(rankings: DataFrame) -> DataFrame:
    """Per method: number of samples, mean, smallest and largest score."""
    return rankings.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
