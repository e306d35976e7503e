"""Budgets, nested subsets of a ranking, their audit, and picks from either end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.functions.keys import seeded_key
from chaffline.session import cut_lineage

REMOVE_EASY = "remove_easy"
REMOVE_HARD = "remove_hard"


def percentile_grid(
    spark: SparkSession,
    smallest: int = 0,
    largest: int = 90,
    step: int = 10,
    percentiles: Sequence[int] | None = None,
) -> DataFrame:
    """The budgets as a table; an explicit list wins over the range."""
    return spark.createDataFrame(
        [(p,) for p in budget_list(smallest, largest, step, percentiles)], "percent_removed int"
    )


def budget_list(
    smallest: int, largest: int, step: int, percentiles: Sequence[int] | None = None
) -> list[int]:
    if percentiles is not None:
        return [int(p) for p in percentiles]
    if step <= 0:
        raise ValueError("the step between budgets must be positive")
    return list(range(smallest, largest + 1, step))


def _budget_rows(ranking: DataFrame, percentiles: Sequence[int], direction: str) -> DataFrame:
    """Ranking rows with `place` (0 goes first) and the size `n` of their ranking.

    The rank is dense from its smallest value, so no sort is needed: the place is the rank, or
    its mirror image. Sizes, one per method, travel as one map literal.
    """
    if direction not in (REMOVE_EASY, REMOVE_HARD):
        raise ValueError(f"direction must be {REMOVE_EASY} or {REMOVE_HARD}, not {direction!r}")
    sizes = (
        ranking.groupBy("method")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("base"))
        .agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("n", "base")))))
        .scalar()
    )
    sized = ranking.withColumn("_size", F.element_at(sizes, F.col("method")))
    from_start = F.col("rank") - F.col("_size.base")
    place = from_start if direction == REMOVE_EASY else F.col("_size.n") - 1 - from_start
    return sized.withColumn("_place", place).withColumn("_n", F.col("_size.n")).drop("_size")


def _cut(percent: Column) -> Column:
    """How many rows a budget removes, by integer division."""
    return F.call_function("div", F.col("_n") * percent, F.lit(100))


def build_subsets(
    ranking: DataFrame, percentiles: Sequence[int], direction: str = REMOVE_EASY
) -> DataFrame:
    """Retained samples per budget: (method, percent_removed, position, sample_id).

    Each row is repeated only for the budgets that keep it.
    """
    budgets = F.array(*[F.lit(int(p)) for p in percentiles])
    rows = _budget_rows(ranking, percentiles, direction)
    kept = F.filter(budgets, lambda p: F.col("_place") >= _cut(p))
    return rows.select(
        "method", "sample_id", "_place", "_n", F.explode(kept).alias("percent_removed")
    ).select(
        "method",
        "percent_removed",
        (F.col("_place") - _cut(F.col("percent_removed"))).alias("position"),
        "sample_id",
    )


def nested_subsets(
    ranking: DataFrame, percentiles: Sequence[int], direction: str = REMOVE_EASY
) -> tuple[DataFrame, DataFrame]:
    """The subsets of all budgets with each sample once, and where each budget begins.

    Returns rows (method, direction, place, sample_id), place 0 going first, and cuts (method,
    direction, percent_removed, cut, n): a budget keeps the places from its cut on. Samples that no
    budget keeps are left out.
    """
    rows = _budget_rows(ranking, percentiles, direction)
    budgets = F.array(*[F.lit(int(p)) for p in percentiles])
    least = F.array_min(F.transform(budgets, lambda p: _cut(p)))
    way = F.lit(direction).alias("direction")
    kept = rows.where(F.col("_place") >= least).select("method", way, F.col("_place").alias("place"), "sample_id")
    cuts = (
        rows.groupBy("method").agg(F.max("_n").alias("_n"))
        .select("method", way, F.explode(budgets).alias("percent_removed"), F.col("_n").alias("n"), "_n")
        .select("method", "direction", "percent_removed", _cut(F.col("percent_removed")).alias("cut"), "n")
    )
    return kept, cuts


def audit_subsets(
    ranking: DataFrame, percentiles: Sequence[int], direction: str = REMOVE_EASY
) -> DataFrame:
    """Per budget: rows kept and removed and their mean scores, NULL where there are none."""
    budgets = F.array(*[F.lit(int(p)) for p in percentiles])
    kept = F.col("_place") >= _cut(F.col("percent_removed"))
    return (
        _budget_rows(ranking, percentiles, direction)
        .withColumn("percent_removed", F.explode(budgets))
        .withColumn("_kept", kept)
        .groupBy("method", "percent_removed")
        .agg(
            F.count_if("_kept").alias("retained"),
            F.count_if(~F.col("_kept")).alias("removed"),
            F.avg(F.when(F.col("_kept"), F.col("score"))).alias("retained_mean_score"),
            F.avg(F.when(~F.col("_kept"), F.col("score"))).alias("removed_mean_score"),
        )
    )


def retained_rows(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose `sample_id` is in `ids`."""
    return frame.join(ids.select("sample_id"), "sample_id", "left_semi")


def removed_rows(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose `sample_id` is not in `ids`."""
    return frame.join(ids.select("sample_id"), "sample_id", "left_anti")


def easy_hard_random(scores: DataFrame, limit: int = 1000, seed: int = 42) -> DataFrame:
    """The lowest, the highest and a seeded draw of min(limit, n div 4) samples each.

    The groups may overlap. Each pick is a bounded top-k, so nothing is sorted as a whole. The
    scores, narrow rows, are written once: what they were computed from is read a single time.
    """
    scores = cut_lineage(scores.select("sample_id", "score"))
    pick = min(limit, scores.count() // 4)

    def first(category: str, *order: Column | str) -> DataFrame:
        return scores.orderBy(*order).limit(pick).select(
            F.lit(category).alias("category"), "sample_id", "score"
        )

    return (
        first("easy", "score", "sample_id")
        .unionByName(first("hard", F.desc("score"), F.desc("sample_id")))
        .unionByName(first("random", seeded_key(seed, "sample_id"), "sample_id"))
    )


def picked_samples(features: DataFrame, picks: DataFrame) -> DataFrame:
    """Feature rows of all picked samples, each once."""
    return features.join(picks.select("sample_id").distinct(), "sample_id", "left_semi")


def attach_scores(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Left lookup of the score by id, 0 where there is none."""
    found = scores.select("sample_id", "score")
    return samples.join(found, "sample_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


# The order in which a ranking is chosen for display.
PREFERRED_METHODS = [
    "effective_rank",
    "corr_integral",
    "intrinsic_dimensionality_twonn",
    "forgetting_events",
    "perplexity_filtering",
    "semantic_dedup",
    "heuristic_filtering",
    "llm_classifier",
    "random",
]


def preferred_ranking(rankings: DataFrame, configured: Sequence[str] | None = None) -> DataFrame:
    """The rows of the first method present: preferred ones first, then the other configured.

    With `configured` unset every preferred method counts as configured. Empty when no ranking
    is there.
    """
    configured = PREFERRED_METHODS if configured is None else list(configured)
    ordered = [m for m in PREFERRED_METHODS if m in configured]
    ordered += [m for m in configured if m not in PREFERRED_METHODS]
    if not ordered:
        return rankings.limit(0)
    priority = F.array_position(F.array(*[F.lit(m) for m in ordered]), F.col("method"))
    usable = rankings.withColumn("_priority", priority).filter("_priority > 0")
    best = usable.agg(F.min("_priority")).scalar()
    return usable.filter(F.col("_priority") == best).drop("_priority")
