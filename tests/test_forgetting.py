import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from chaffline.plans import flagship
from chaffline.plans.views import predictions
from chaffline.scorers import forgetting as G
from chaffline.scorers.registry import get_scorer
from chaffline.streaming import forgetting as S

LOG = "seed long, sample_id long, epoch int, step long, correct int"


def log_of(spark, sequences):
    """{(seed, sample): [0/1, ...]} as a log of one epoch."""
    rows = [
        (seed, sample, 0, step, correct)
        for (seed, sample), steps in sequences.items()
        for step, correct in enumerate(steps)
    ]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, LOG)


def python_counts(sequences):
    found = {}
    for key, steps in sequences.items():
        falls = sum(a > b for a, b in zip([0, *steps], steps))
        found[key] = (falls, any(steps))
    return found


def as_dict(counts):
    return {(r.seed, r.sample_id): (r.forgetting, r.ever_learnt) for r in counts.collect()}


SEQUENCES = {
    (0, 1): [1, 0, 1, 0],
    (0, 2): [0, 0, 0],
    (0, 3): [1, 1, 1],
    (1, 1): [0, 1, 1, 0, 0],
    (1, 2): [0],
    (1, 4): [1],
}


def test_counts(spark):
    assert as_dict(G.forgetting_counts(log_of(spark, SEQUENCES))) == python_counts(SEQUENCES)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_one_sample_with_a_third_of_the_rows(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    draw = random.Random(1)
    sequences = {(0, i): [draw.randint(0, 1) for _ in range(40)] for i in range(100)}
    sequences[(0, 7)] = [draw.randint(0, 1) for _ in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(G.forgetting_counts(log_of(spark, sequences))) == python_counts(sequences)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_epochs_come_before_steps(spark):
    rows = [(0, 1, 1, 0, 0), (0, 1, 0, 5, 1), (0, 1, 1, 1, 1)]
    counts = G.forgetting_counts(spark.createDataFrame(rows, LOG)).first()
    assert (counts.forgetting, counts.ever_learnt) == (1, True)


def test_ensemble(spark):
    found = {
        r.sample_id: (r.score, r.never_learnt)
        for r in G.forgetting_ensemble(G.forgetting_counts(log_of(spark, SEQUENCES))).collect()
    }
    # Sample 1 falls twice and once; 2 is never right in both seeds; 3 and 4 miss a seed.
    assert found == {1: (1.5, False), 2: (2.5, True), 3: (0.0, False), 4: (0.0, False)}


def test_never_learnt_needs_every_seed(spark):
    sequences = {(0, 1): [1, 0], (1, 1): [1], (0, 2): [0, 0]}
    rows = G.forgetting_ensemble(G.forgetting_counts(log_of(spark, sequences)))
    assert {r.sample_id: r.never_learnt for r in rows.collect()} == {1: False, 2: False}


def test_ranking_and_statistics(spark):
    log = log_of(spark, SEQUENCES).withColumn("label", F.col("sample_id") * 10)
    ranking = get_scorer("forgetting_events").score(log).orderBy("rank").collect()
    assert [(r.sample_id, r.label, r.rank) for r in ranking] == [(3, 30, 0), (4, 40, 1), (1, 10, 2), (2, 20, 3)]
    stats = G.forgetting_statistics(G.forgetting_ensemble(G.forgetting_counts(log))).first()
    assert (stats.n_samples, stats.n_unforgettable, stats.n_never_learnt) == (4, 2, 1)
    assert (stats.pct_unforgettable, stats.max_score, stats.mean_score) == (50.0, 2.5, 1.0)


def histogram(frame):
    return {(r.events, r.never_learnt): r.n for r in frame.collect()}


def test_histogram(spark):
    scores = spark.createDataFrame(
        [(i, s, s > 5) for i, s in enumerate([0.0, 0.0, 0.5, 1.0, 3.2, 6.0])],
        "sample_id long, score double, never boolean",
    )
    by_gap = histogram(G.forgetting_histogram(scores))
    assert by_gap == {(0, False): 2, (1, False): 2, (2, False): 0, (3, False): 1, (4, False): 0, (None, True): 1}
    assert histogram(G.forgetting_histogram(scores, "never")) == by_gap
    tied = scores.withColumn("score", F.lit(2.0))
    assert histogram(G.forgetting_histogram(tied)) == {(0, False): 0, (1, False): 0, (2, False): 6}


def test_sorted_curve(spark):
    scores = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 0.0)], "sample_id long, score double")
    found = G.forgetting_sorted(scores).orderBy("position").collect()
    assert [(r.sample_id, r.unforgettable) for r in found] == [(2, True), (3, True), (1, False)]


@pytest.mark.parametrize("segment_steps", [7, S.SEGMENT_STEPS])
@pytest.mark.parametrize("order", [(0, 10, 20), (20, 10, 0), (10, 20, 0)])
def test_stream_equals_batch_in_any_order(spark, tmp_path, segment_steps, order):
    draw = random.Random(2)
    sequences = {(s, i): [draw.randint(0, 1) for _ in range(30)] for s in range(2) for i in range(5)}
    log = log_of(spark, sequences)
    source, place = str(tmp_path / "log"), str(tmp_path / "out")
    for start in order:
        part = log.filter(F.col("step").between(start, start + 9))
        part.coalesce(1).write.mode("append").parquet(source)
        # Each call takes up where the one before stopped.
        stream = spark.readStream.schema(LOG).parquet(source)
        S.start_forgetting(stream, place, segment_steps).awaitTermination()
    assert as_dict(S.read_forgetting_counts(spark, place)) == python_counts(sequences)
    assert S.repeated_rows(spark, place).first().repeated == 0


def test_interleaved_late_rows_are_merged(spark, tmp_path):
    """Eight rows of a sample in two files, the later steps first and some in between."""
    source, place = str(tmp_path / "log"), str(tmp_path / "out")
    steps = [1, 0, 1, 0, 1, 0, 1, 0]
    files = [[(0, 1, 0, i, steps[i]) for i in own] for own in ((1, 4, 5, 7), (0, 2, 3, 6))]
    for rows in files:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        S.start_forgetting(stream, place).awaitTermination()
    assert as_dict(S.read_forgetting_counts(spark, place)) == {(0, 1): (4, True)}


def test_repeated_rows_are_told(spark, tmp_path):
    source, place = str(tmp_path / "log"), str(tmp_path / "out")
    for rows in ([(0, 1, 0, 0, 1), (0, 1, 0, 4, 0)], [(0, 1, 0, 4, 0), (0, 1, 0, 5, 1)]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        S.start_forgetting(stream, place).awaitTermination()
    assert as_dict(S.read_forgetting_counts(spark, place)) == {(0, 1): (1, True)}
    assert S.repeated_rows(spark, place).first().repeated == 1


def test_only_changed_counts_are_emitted(spark, tmp_path):
    source, place, seen = str(tmp_path / "log"), str(tmp_path / "out"), []

    def note(counts, _):
        seen.append({(r.sample_id, r.forgetting) for r in counts.collect()})

    for rows in ([(0, 1, 0, 0, 1), (0, 2, 0, 0, 1)], [(0, 2, 0, 9, 0)], [(0, 1, 1, 0, 0), (0, 2, 0, 5, 0), (0, 2, 0, 7, 1)]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        S.start_forgetting(stream, place, segment_steps=4, on_change=note).awaitTermination()
    assert seen == [{(1, 0), (2, 0)}, {(2, 1)}, {(1, 1), (2, 2)}]


def test_merge_of_steps():
    steps, correct, repeated = S.merge_steps(np.array([1, 5]), np.array([1, 1]), np.array([5, 0, 9, 9]), np.array([0, 1, 1, 1]))
    assert (steps.tolist(), correct.tolist(), repeated) == ([0, 1, 5, 9], [1, 1, 0, 1], 2)


def test_nothing_written_yet(spark, tmp_path):
    assert S.read_forgetting_counts(spark, str(tmp_path)).collect() == []


def test_late_parts_are_a_batch_each_however_many_files(spark, tmp_path, monkeypatch):
    """Before, each file of a part was a batch, and a part had more of them the larger the table."""
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"),
        (F.col("id") * 7 % 20).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    started, start = [], S.start_forgetting
    monkeypatch.setattr(flagship, "FILE_ROWS", 200, raising=False)
    monkeypatch.setattr(flagship.streaming, "start_forgetting", lambda *a: started.append(start(*a)) or started[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = as_dict(flagship.streaming_forgetting_late(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert started[0].lastProgress.batchId < flagship.STREAM_FILES + 1
    assert found == as_dict(G.forgetting_counts(predictions(spark, str(tmp_path))))


def test_samples_share_keys_of_the_state(spark, tmp_path):
    """Before, every sample was a key, and each key costs calls to the state. No sample is a sample, too."""
    source, place = str(tmp_path / "log"), str(tmp_path / "out")
    steps = [1, 0, 1, 0]
    rows = [(0, sample, 0, i, steps[i]) for sample in [None, *range(-500, 500)] for i in range(4)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(source)
    S.start_forgetting(spark.readStream.schema(LOG).parquet(source), place).awaitTermination()
    assert as_dict(S.read_forgetting_counts(spark, place)) == {(0, s): (2, True) for s in [None, *range(-500, 500)]}
    state = spark.read.format("statestore").option("stateVarName", "rows").option("operatorId", 1)
    assert state.load(f"{place}/checkpoint").count() <= S.SEGMENT_GROUPS + 1
