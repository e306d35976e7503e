"""Forgetting events from a prediction log (seed, sample_id, epoch, step, correct)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffline.operators.positions import with_position

_KEYS = ["seed", "sample_id"]
_ORDER = ["epoch", "step"]


def forgetting_counts(log: DataFrame) -> DataFrame:
    """(seed, sample_id, forgetting, ever_learnt): correct-to-wrong steps in training order.

    The log is cut into sorted range partitions of (seed, sample, epoch, step), its only shuffle; a
    sample with a large share of all rows then spans several of them. Each run of rows of a
    sample in an Arrow batch becomes a segment, and the segments of a sample, few rows, are joined
    end to end.
    """
    longs = [F.col(c).cast("long").alias(c) for c in (*_KEYS, *_ORDER)]
    ordered = (
        log.select(*longs, F.col("correct").cast("int").alias("correct"))
        .repartitionByRange(*_KEYS, *_ORDER)
        .sortWithinPartitions(*_KEYS, *_ORDER, "correct")
    )
    segments = ordered.mapInArrow(
        _segments,
        "seed long, sample_id long, first_at struct<epoch: long, step: long>, first_correct int, "
        "last_correct int, falls long, learnt int",
    )
    return join_segments(segments)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, sample, epoch, step, correct = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(seed), bool)
        new[1:] = (np.diff(seed) != 0) | (np.diff(sample) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(seed)) - 1
        fell = np.zeros(len(seed), np.int64)
        fell[1:] = (correct[1:] < correct[:-1]) & ~new[1:]
        place = pa.StructArray.from_arrays([pa.array(epoch[first]), pa.array(step[first])], ["epoch", "step"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seed[first]),
                pa.array(sample[first]),
                place,
                pa.array(correct[first]),
                pa.array(correct[last]),
                pa.array(np.add.reduceat(fell, first)),
                pa.array(np.maximum.reduceat(correct, first)),
            ],
            names=["seed", "sample_id", "first_at", "first_correct", "last_correct", "falls", "learnt"],
        )


def join_segments(segments: DataFrame) -> DataFrame:
    """Counts per (seed, sample) from its segments, which follow each other by `first_at`.

    A step from correct to wrong may also lie between two segments. The row before the very
    first counts as wrong.
    """
    between = Window.partitionBy(*_KEYS).orderBy("first_at")
    fell_between = F.lag("last_correct", 1, 0).over(between) > F.col("first_correct")
    return (
        segments.withColumn("_falls", F.col("falls") + fell_between.cast("long"))
        .groupBy(*_KEYS)
        .agg(F.sum("_falls").alias("forgetting"), (F.max("learnt") == 1).alias("ever_learnt"))
    )


def forgetting_ensemble(counts: DataFrame) -> DataFrame:
    """(sample_id, score, never_learnt): mean count over all seeds, float32.

    The sum is divided by the number of seeds in the whole log, not by those that hold the
    sample. A sample learnt under no seed, and present under every one, scores the largest mean
    plus 1.
    """
    seeds = counts.agg(F.count_distinct("seed")).scalar()
    per_sample = counts.groupBy("sample_id").agg(
        (F.sum("forgetting") / seeds).cast("float").alias("_mean"),
        (F.count_if(~F.col("ever_learnt")) == seeds).alias("never_learnt"),
    )
    largest = per_sample.agg(F.max("_mean")).scalar()
    score = F.when(F.col("never_learnt"), (largest + F.lit(1).cast("float")).cast("float"))
    return per_sample.select(
        "sample_id", score.otherwise(F.col("_mean")).cast("double").alias("score"), "never_learnt"
    )


def forgetting_scores(log: DataFrame) -> DataFrame:
    return forgetting_ensemble(forgetting_counts(log)).select("sample_id", "score")


def forgetting_statistics(ensemble: DataFrame) -> DataFrame:
    """One row: unforgettable and never learnt samples, their shares, mean and largest score."""
    n = F.count(F.lit(1))
    easy = F.count_if(F.col("score") == 0)
    never = F.count_if("never_learnt")
    return ensemble.agg(
        n.alias("n_samples"),
        easy.alias("n_unforgettable"),
        never.alias("n_never_learnt"),
        (easy * 100.0 / n).alias("pct_unforgettable"),
        (never * 100.0 / n).alias("pct_never_learnt"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
    )


# Fixed value: a top score this far above the next one is read as "never learnt".
NEVER_LEARNT_GAP = 0.5


def forgetting_histogram(scores: DataFrame, never_learnt: str | None = None) -> DataFrame:
    """(events, n, never_learnt): samples per whole number of events, empty bins included.

    Never learnt samples leave the bins and are counted in one row with `events` NULL. They are
    known by the flag column named, or else by a gap below the top score; a real gap can be
    taken for them, so prefer the flag where there is one.
    """
    distinct = scores.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    if never_learnt is None:
        top = distinct.orderBy(F.desc("score")).limit(2)
        bounds = top.agg(
            F.max("score").alias("top"), F.min("score").alias("next"), F.count(F.lit(1)).alias("k")
        )
        limit = bounds.select(
            F.when(
                (F.col("k") == 2) & (F.col("top") > F.col("next") + NEVER_LEARNT_GAP), F.col("top")
            )
        ).scalar()
        flagged = distinct.withColumn("_never", F.coalesce(F.col("score") >= limit, F.lit(False)))
    else:
        flagged = scores.groupBy("score", F.col(never_learnt).alias("_never")).agg(
            F.count(F.lit(1)).alias("_n")
        )
    shown = flagged.filter(~F.col("_never"))
    # Bins run from 0 to the top score rounded up, an edge value falling into the upper bin.
    last = shown.agg(F.ceil(F.max("score")).alias("last"))
    bins = last.filter("last is not null").select(
        F.explode(F.expr("sequence(0, last)")).alias("events")
    )
    filled = shown.groupBy(F.floor(F.col("score") + 0.5).alias("events")).agg(
        F.sum("_n").alias("n")
    )
    histogram = bins.join(filled, "events", "left").select(
        "events", F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("never_learnt")
    )
    never = flagged.filter("_never").agg(F.sum("_n").alias("n")).filter("n is not null")
    return histogram.unionByName(
        never.select(F.lit(None).cast("long").alias("events"), "n", F.lit(True).alias("never_learnt"))
    )


def forgetting_sorted(scores: DataFrame) -> DataFrame:
    """(position, sample_id, score, unforgettable): samples by ascending score, zeros marked."""
    placed = with_position(scores.select("sample_id", "score"), ["score", "sample_id"])
    return placed.select("position", "sample_id", "score", (F.col("score") == 0).alias("unforgettable"))
