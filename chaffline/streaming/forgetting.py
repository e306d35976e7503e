"""Forgetting counts over an arriving prediction log, in Spark's keyed state.

Two stateful steps, both on groups of samples, as a call to the state costs as much as hundreds of
rows. The first is keyed by (seed, epoch, stretch of `SEGMENT_STEPS` steps, one of `SEGMENT_GROUPS`
groups of samples) and keeps the outcomes of each sample's steps as sorted offsets and bits, so rows
may arrive in any order and at any time; of a sample's segment that got rows it emits a summary of one
row. The second is keyed by (seed, one of `COUNT_GROUPS` groups), keeps the summaries of its samples'
segments, joins them end to end and emits the counts that changed. A sample with a large share of the
log is so spread over many keys of the first step, and the second sees a row per segment. Reading
counts costs a few bytes per sample: they are read from the state itself, or taken from the stream
of changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

SEGMENT_STEPS = 100_000
# Groups of samples by hash: of a segment, and of a seed. A group's state is read and written whole.
SEGMENT_GROUPS, COUNT_GROUPS = 128, 4096
# The group of rows without a sample.
_NO_SAMPLE = -1

_SEGMENT_KEY = ["seed", "epoch", "segment", "group"]
_SEGMENT = "first_correct int, last_correct int, falls long, learnt int, repeated long"
_COUNTS = "seed long, sample_id long, forgetting long, ever_learnt boolean, repeated long"
# A segment's summary and a sample's counts as the state has them.
_SUMMARY_ROW = np.dtype(
    [("sample_id", "<i8"), ("epoch", "<i8"), ("segment", "<i8"), ("falls", "<i8"), ("repeated", "<i8")]
    + [("first_correct", "u1"), ("last_correct", "u1"), ("learnt", "u1")]
)
_COUNTS_ROW = np.dtype([("sample_id", "<i8"), ("forgetting", "<i8"), ("repeated", "<i8"), ("ever_learnt", "?")])
# Value of Spark's setting for a state store that these steps can use.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_steps(
    steps: np.ndarray, correct: np.ndarray, more: np.ndarray, outcomes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sets of steps in order with their outcomes, and how many repeated a step.

    Of rows that repeat a step the wrong one counts.
    """
    steps, correct = np.concatenate([steps, more]), np.concatenate([correct, outcomes])
    order = np.lexsort((correct, steps))
    steps, correct = steps[order], correct[order]
    new = np.ones(len(steps), bool)
    new[1:] = steps[1:] != steps[:-1]
    return steps[new], correct[new], int((~new).sum())


def _given(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key; a value that is missing would be counted as some number."""
    given = pd.concat(list(rows), ignore_index=True)
    if given.isna().to_numpy().any():
        raise ValueError("a prediction log needs epoch, step and correct in every row")
    return given


class SegmentProcessor(StatefulProcessor):
    """Outcomes of the steps of a segment, for a group of samples; emits summaries of those that rows have come for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Samples in order with their numbers of steps and of repeated rows, 20 bytes a sample; then the
        # steps sample by sample: offsets inside the segment, 4 bytes each, and outcomes as bits.
        held = "samples binary, sizes binary, repeated binary, steps binary, correct binary"
        self._rows = handle.getValueState("rows", held)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = _given(rows)
        held = self._rows.get() or (b"", b"", b"", b"", b"")
        known, sizes, again, steps, bits = (
            np.frombuffer(part, kind) for part, kind in zip(held, ("<i8", "<i4", "<i8", "<i4", "u1"))
        )
        correct = np.unpackbits(bits)[: len(steps)]
        samples, place = np.unique(np.concatenate([known, given["sample_id"].to_numpy("i8")]), return_inverse=True)
        before, coming = np.repeat(place[: len(known)], sizes), place[len(known) :]
        # Step and sample as one number, so all samples are merged at once.
        both, correct, _ = merge_steps(
            before << 32 | steps, correct, coming << 32 | given["step"].to_numpy("i8"), given["correct"].to_numpy("u1")
        )
        owner, steps = both >> 32, both & 0xFFFFFFFF
        n = len(samples)
        sizes = np.bincount(owner, minlength=n)
        repeated = np.bincount(before, minlength=n) + np.bincount(coming, minlength=n) - sizes
        repeated[place[: len(known)]] += again
        self._rows.update((
            samples.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), repeated.astype("<i8").tobytes(),
            steps.astype("<i4").tobytes(), np.packbits(correct).tobytes(),
        ))
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        fell = (correct[1:] < correct[:-1]) & (owner[1:] == owner[:-1])
        falls = np.bincount(owner[1:][fell], minlength=n)
        changed = np.unique(coming)
        yield pd.DataFrame({
            "seed": key[0], "epoch": key[1], "segment": key[2], "group": key[3],
            "sample_id": samples[changed],
            "first_correct": correct[first][changed].astype(np.int32),
            "last_correct": correct[last][changed].astype(np.int32),
            "falls": falls[changed],
            "learnt": np.maximum.reduceat(correct, first)[changed].astype(np.int32),
            "repeated": repeated[changed],
        })

    def close(self) -> None:
        pass


class CountProcessor(StatefulProcessor):
    """Summaries of the segments of a group of samples; emits the counts of those with a segment that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._segments = handle.getValueState("segments", "summaries binary")
        self._counts = handle.getValueState("counts", "counts binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = _given(rows)
        changed = np.zeros(len(given), _SUMMARY_ROW)
        for name in _SUMMARY_ROW.names:
            changed[name] = given[name].to_numpy()
        held = self._segments.get()
        every = np.concatenate([np.frombuffer(held[0] if held else b"", _SUMMARY_ROW), changed])
        every = every[np.lexsort((np.arange(len(every)), every["segment"], every["epoch"], every["sample_id"]))]
        # A new summary takes the place of the one before it.
        place = every[["sample_id", "epoch", "segment"]]
        every = every[np.append(place[1:] != place[:-1], True)]
        self._segments.update((every.tobytes(),))
        same = every["sample_id"][1:] == every["sample_id"][:-1]
        first = np.flatnonzero(np.append(True, ~same))
        # A step from correct to wrong may also lie between two segments.
        falls = every["falls"].copy()
        falls[1:] += same & (every["last_correct"][:-1] > every["first_correct"][1:])
        counts = np.zeros(len(first), _COUNTS_ROW)
        counts["sample_id"] = every["sample_id"][first]
        counts["forgetting"] = np.add.reduceat(falls, first)
        counts["repeated"] = np.add.reduceat(every["repeated"], first)
        counts["ever_learnt"] = np.maximum.reduceat(every["learnt"], first) > 0
        self._counts.update((counts.tobytes(),))
        counts = counts[np.isin(counts["sample_id"], changed["sample_id"])]
        yield pd.DataFrame({"seed": key[0], "group": key[1], **{c: counts[c] for c in _COUNTS_ROW.names}})

    def close(self) -> None:
        pass


def _group(sample: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(sample), F.lit(groups)).cast("int")


def _with_missing_sample(counts: DataFrame) -> DataFrame:
    sample = F.when(F.col("group") != _NO_SAMPLE, F.col("sample_id")).alias("sample_id")
    return counts.select("seed", sample, "forgetting", "ever_learnt", "repeated")


def count_changes(log: DataFrame, segment_steps: int = SEGMENT_STEPS) -> DataFrame:
    """The stream of changed counts (seed, sample_id, forgetting, ever_learnt, repeated) of a log.

    A sample's latest row is its count so far; `repeated` tells how many of its rows repeated a step.
    """
    sample = F.col("sample_id").cast("long")
    keyed = log.select(
        F.col("seed").cast("long").alias("seed"),
        F.col("epoch").cast("long").alias("epoch"),
        F.call_function("div", F.col("step"), F.lit(segment_steps)).cast("long").alias("segment"),
        F.when(sample.isNull(), _NO_SAMPLE).otherwise(_group(sample, SEGMENT_GROUPS)).alias("group"),
        F.coalesce(sample, F.lit(0)).alias("sample_id"),
        F.pmod(F.col("step"), F.lit(segment_steps)).cast("int").alias("step"),
        F.col("correct").cast("int").alias("correct"),
    )
    segments = keyed.groupBy(*_SEGMENT_KEY).transformWithStateInPandas(
        SegmentProcessor(),
        f"seed long, epoch long, segment long, group int, sample_id long, {_SEGMENT}",
        "Append",
        "None",
    )
    missing = F.col("group") == _NO_SAMPLE
    joined = segments.withColumn("group", F.when(missing, F.col("group")).otherwise(_group(F.col("sample_id"), COUNT_GROUPS)))
    counts = joined.groupBy("seed", "group").transformWithStateInPandas(
        CountProcessor(),
        "seed long, group int, sample_id long, forgetting long, ever_learnt boolean, repeated long",
        "Append",
        "None",
    )
    return _with_missing_sample(counts)


def start_forgetting(
    log: DataFrame,
    folder: str,
    segment_steps: int = SEGMENT_STEPS,
    trigger: dict[str, Any] | None = None,
    on_change=None,
) -> StreamingQuery:
    """Run the operator with its state and progress in `folder`.

    `on_change(counts, batch_id)` gets the changed counts of each batch; without it they stay in the
    state, from which `read_forgetting_counts` takes them.
    """
    spark = log.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    # The query keeps the setting it starts with.
    spark.conf.set(setting, _STORE)
    try:
        writer = count_changes(log, segment_steps).writeStream.outputMode("append")
        writer = writer.format("noop") if on_change is None else writer.foreachBatch(on_change)
        return (
            writer.option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(setting, before)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """(seed, sample_id, forgetting, ever_learnt, repeated) as the state has them after the last batch."""
    place = f"{folder}/checkpoint"
    try:
        steps = spark.read.format("state-metadata").load(place).select("operatorId", "operatorProperties").distinct()
        known = [r.operatorId for r in steps.collect() if '"counts"' in r.operatorProperties]  # a row per step
    except AnalysisException as missing:
        if "STDS" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
            raise
        known = []
    if not known:
        return spark.createDataFrame([], _COUNTS)
    state = spark.read.format("statestore").option("operatorId", known[0]).option("stateVarName", "counts").load(place)
    groups = state.select("key.seed", "key.group", "value.counts")
    counts = "seed long, group int, sample_id long, forgetting long, ever_learnt boolean, repeated long"
    return _with_missing_sample(groups.mapInArrow(_rows_of_groups, counts))


def _rows_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seed, group, held in zip(*(column.to_pylist() for column in batch.columns)):
            counts = np.frombuffer(held, _COUNTS_ROW)
            parts = {c: pa.array(counts[c]) for c in ("sample_id", "forgetting", "ever_learnt", "repeated")}
            keys = {"seed": pa.array([seed] * len(counts), pa.int64()), "group": pa.array([group] * len(counts), pa.int32())}
            yield pa.RecordBatch.from_pydict(keys | parts)


def read_forgetting_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(seed, sample_id, forgetting, ever_learnt) over all batches so far."""
    return _counts(spark, folder).drop("repeated")


def repeated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many rows repeated a step that was there already."""
    return _counts(spark, folder).agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"))
