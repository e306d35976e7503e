import math

import pytest
from pyspark.sql import functions as F

from chaffline.operators.positions import with_position, with_rank
from chaffline.scorers.base import RANKING_SCHEMA, rank_together
from chaffline.scorers import registry
from chaffline.scorers.registry import SCORERS, get_scorer


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "sample_id long, score double")


def test_ties_go_to_the_smaller_id(spark):
    ranked = with_rank(scores(spark, [(10, 0.1), (5, 0.1), (3, 0.2), (20, 0.2)]))
    assert [r.sample_id for r in ranked.orderBy("rank").collect()] == [5, 10, 3, 20]
    assert [r.rank for r in ranked.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_nan_comes_last_and_base_one(spark):
    ranked = with_rank(scores(spark, [(1, float("nan")), (2, 5.0), (3, -1.0)]), base=1)
    assert {r.sample_id: r.rank for r in ranked.collect()} == {3: 1, 2: 2, 1: 3}


def test_empty_and_single(spark):
    assert with_rank(scores(spark, []).limit(0)).count() == 0
    assert with_rank(scores(spark, [(7, 1.0)])).first().rank == 0


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_same_rank_under_any_partitioning(spark, shuffle_partitions, partitions):
    shuffle_partitions(partitions)
    rows = spark.range(5000).select(
        F.col("id").alias("sample_id"), (F.col("id") * 7919 % 13).cast("double").alias("score")
    )
    found = {r.sample_id: r.rank for r in with_rank(rows).collect()}
    order = sorted(range(5000), key=lambda i: (i * 7919 % 13, i))
    assert found == {sample: place for place, sample in enumerate(order)}


def test_positions_within_groups_with_one_hot_group(spark, shuffle_partitions):
    shuffle_partitions(16)
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 7).alias("g")
    )
    found = with_position(rows, ["id"], within=["g"]).collect()
    seen = {}
    for r in sorted(found, key=lambda r: r.id):
        assert r.position == seen.get(r.g, 0)
        seen[r.g] = r.position + 1


def test_null_group_counts_on_its_own(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id long, g long")
    found = {r.id: r.position for r in with_position(rows, ["id"], within=["g"]).collect()}
    assert found == {1: 0, 2: 1, 3: 0}


def test_all_scores_tied(spark):
    ranked = with_rank(spark.range(1000).select(F.col("id").alias("sample_id"), F.lit(0.5).alias("score")))
    assert ranked.filter("rank <> sample_id").count() == 0


def test_random_scorer_repeats_and_changes_with_the_seed(spark):
    labels = spark.range(50).select(
        F.col("id").alias("sample_id"), (F.col("id") % 10).alias("label")
    )
    order = lambda seed: [
        r.sample_id for r in get_scorer("random", seed=seed).score(labels).orderBy("rank").collect()
    ]
    assert order(777) == order(777) != order(778)
    ranking = get_scorer("random").score(labels)
    assert ranking.schema.names == RANKING_SCHEMA.names
    assert [f.dataType for f in ranking.schema] == [f.dataType for f in RANKING_SCHEMA]
    top = ranking.agg(F.min("score"), F.max("score")).first()
    assert (top[0], top[1]) == (0.0, 1.0)


def test_random_scorer_of_one_sample(spark):
    one = spark.createDataFrame([(4, 1)], "sample_id long, label long")
    row = get_scorer("random").score(one).first()
    assert (row.score, row.rank) == (0.0, 0)


def test_missing_input_is_named(spark):
    with pytest.raises(ValueError, match="features"):
        get_scorer("semantic_dedup").score(spark.range(3).withColumnRenamed("id", "sample_id"))
    with pytest.raises(ValueError, match="label"):
        get_scorer("heuristic_filtering").score(
            spark.createDataFrame([(1, "a")], "sample_id long, text string")
        )


def test_unknown_method_is_an_error():
    with pytest.raises(ValueError, match="no_such"):
        get_scorer("no_such")


def test_kinds_of_input():
    assert registry.is_forgetting_method("forgetting_events")
    kinds = {
        registry.is_hidden_state_method: {"effective_rank", "corr_integral"},
        registry.is_feature_method: {"intrinsic_dimensionality_twonn", "semantic_dedup"},
        registry.is_text_model_method: {"perplexity_filtering", "llm_classifier"},
        registry.is_text_heuristic_method: {"heuristic_filtering"},
    }
    for check, methods in kinds.items():
        assert {m for m in SCORERS if check(m)} == methods
    assert not registry.is_feature_method("no_such")


def test_ranks_of_several_methods_at_once(spark):
    a = scores(spark, [(1, 3.0), (2, 1.0)]).selectExpr("*", "0L as label", "'a' as method")
    b = scores(spark, [(1, 0.0), (2, 1.0), (3, 1.0)]).selectExpr("*", "0L as label", "'b' as method")
    found = {(r.method, r.sample_id): r.rank for r in rank_together([a, b], {"b": 1}).collect()}
    assert found == {("a", 2): 0, ("a", 1): 1, ("b", 1): 1, ("b", 2): 2, ("b", 3): 3}


def test_scores_are_single_precision(spark):
    rows = spark.createDataFrame([(1, 0, "ab1 ,")], "sample_id long, label long, text string")
    row = get_scorer("heuristic_filtering").score(rows).first()
    exact = 0.4 * 2 / 5 + 0.3 * 5 / 5 + 0.15 * (1 - 1 / 5) + 0.15 * (1 - 1 / 5)
    assert row.score != exact and math.isclose(row.score, exact, rel_tol=1e-6)


def test_one_label_per_sample(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "d e")], "sample_id long, text string")
    labels = spark.createDataFrame([(1, 5), (1, 3), (2, 7), (2, 7)], "sample_id long, label long")
    ranked = get_scorer("heuristic_filtering").score(rows, labels).collect()
    assert sorted((r.sample_id, r.label) for r in ranked) == [(1, 3), (2, 7)]
