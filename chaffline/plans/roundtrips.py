"""Queries that write what the library stores and read it back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.operators import curves as C
from chaffline.operators import subsets
from chaffline.operators.splits import random_split
from chaffline.plans import analysis, ranking
from chaffline.plans.views import EPOCH_METRICS, RUN_RESULTS, epoch_metrics, run_results, sample_labels
from chaffline.session import checkpoint_folder
from chaffline.sources import artifacts
from chaffline.sources.runs import compact_runs, compacted_runs, write_text


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_rankings(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "rankings")
    artifacts.save_rankings(ranking.all_rankings(spark, folder), place, "documents")
    return artifacts.read_rankings(spark, place)


def stored_split(spark: SparkSession, folder: str) -> DataFrame:
    """Created once; the second call finds it, whatever its seed."""
    place = _place(spark, "split")
    labels = sample_labels(spark, folder)
    artifacts.load_or_create_split(spark, place, lambda seed: random_split(labels, 0.1, seed), ranking.SPLIT_SEED)
    return artifacts.load_or_create_split(spark, place, lambda seed: labels.limit(0), ranking.SPLIT_SEED + 1)


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One summary per method and budget, that of the smallest seed, each in a file of its own."""
    place = _place(spark, "runs")
    values = F.struct("seed", "best_val_acc", "best_val_loss", "test_acc")
    runs = (
        run_results(spark, folder)
        .groupBy("method", "percent_removed")
        .agg(F.min(values).alias("_first"))
        .select("method", "percent_removed", "_first.*")
    )
    for row in runs.collect():  # a row per method and budget
        name = f"{place}/{row.method}/p{row.percent_removed:02d}/seed{row.seed}/run_summary.json"
        write_text(name, json.dumps(row.asDict()))
    compact_runs(spark, place, f"{place}-table")
    return analysis.rounded(compacted_runs(spark, f"{place}-table"))


def stored_nested_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """The subsets of both directions, each sample stored once for all budgets of a direction."""
    place = _place(spark, "nested")
    for direction in (subsets.REMOVE_EASY, subsets.REMOVE_HARD):
        artifacts.save_nested_subsets(ranking.heuristic_ranking(spark, folder), ranking.BUDGETS, place, direction)
    return artifacts.read_nested_subsets(spark, place)


def stored_epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Files under both namings, and columns in two orders, in one folder."""
    place = _place(spark, "metrics")
    metrics = epoch_metrics(spark, folder)
    even, odd = metrics.filter("epoch % 2 = 0"), metrics.filter("epoch % 2 = 1")
    plain = even.select("epoch", "val_acc", "val_loss")
    named = odd.select(
        F.col("val_loss").alias("val_loss_epoch"), "epoch", F.col("val_acc").alias("val_acc_epoch"), F.lit(0).alias("val_acc")
    )
    for frame in (plain, named):
        frame.write.mode("append").csv(place, header=True)
    read = artifacts.read_epoch_metrics(spark, place)
    return read.select("epoch", *[F.round(c, 6).alias(c) for c in ("val_acc", "val_loss")])


def stored_curves(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "curves")
    curves = C.aggregate_curves(run_results(spark, folder))
    artifacts.save_curves(curves, place)
    return analysis.rounded(spark.read.schema(curves.schema).json(f"{place}/curve_metrics_json"))


QUERIES = {
    "stored_rankings": (stored_rankings, f"WITH {ranking.BOTH_SQL} SELECT * FROM rankings"),
    "stored_split": (
        stored_split,
        f"SELECT *, CAST({ranking.SPLIT_SEED} AS BIGINT) AS split_seed FROM ({ranking.QUERIES['random_split'][1]})",
    ),
    "stored_runs": (
        stored_runs,
        f"""WITH {RUN_RESULTS}, firsts AS (
          SELECT * FROM run_results QUALIFY row_number() OVER (
            PARTITION BY method, percent_removed ORDER BY seed, best_val_acc, best_val_loss, test_acc) = 1)
        SELECT method, percent_removed, seed, round(best_val_acc, 6) AS best_val_acc,
               round(best_val_loss, 6) AS best_val_loss, round(test_acc, 6) AS test_acc FROM firsts""",
    ),
    "stored_epoch_metrics": (
        stored_epoch_metrics,
        f"""WITH {EPOCH_METRICS}
        SELECT epoch, round(val_acc, 6) AS val_acc, round(val_loss, 6) AS val_loss FROM epoch_metrics""",
    ),
    "stored_nested_subsets": (
        stored_nested_subsets,
        " UNION ALL ".join(
            f"SELECT method, '{direction}' AS direction, percent_removed, position, sample_id FROM ({sql})"
            for direction, sql in (
                (subsets.REMOVE_EASY, ranking.QUERIES["subset_remove_easy"][1]),
                (subsets.REMOVE_HARD, ranking.QUERIES["subset_remove_hard"][1]),
            )
        ),
    ),
    "stored_curves": (stored_curves, analysis.QUERIES["aggregate_curves"][1]),
}
