import pytest
from pyspark.sql import functions as F

from chaffline.operators import subsets as S


def ranking(spark, n, base=0, method="m"):
    return spark.range(n).select(
        F.col("id").alias("sample_id"),
        F.lit(0).cast("long").alias("label"),
        F.lit(0.1).alias("score"),
        (F.col("id") + base).alias("rank"),
        F.lit(method).alias("method"),
    )


def sizes(frame):
    return {r.percent_removed: r["count"] for r in frame.groupBy("percent_removed").count().collect()}


@pytest.mark.parametrize("base", [0, 1])
def test_sizes_of_budgets(spark, base):
    found = S.build_subsets(ranking(spark, 100, base), [0, 5, 10, 60])
    assert sizes(found) == {0: 100, 5: 95, 10: 90, 60: 40}


def test_integer_division_and_extremes(spark):
    found = S.build_subsets(ranking(spark, 7), [0, 50, 99, 100])
    assert sizes(found) == {0: 7, 50: 4, 99: 1}


def test_directions_drop_opposite_ends_and_keep_order(spark):
    easy = S.build_subsets(ranking(spark, 10), [30], "remove_easy").orderBy("position").collect()
    hard = S.build_subsets(ranking(spark, 10), [30], "remove_hard").orderBy("position").collect()
    assert [r.sample_id for r in easy] == [3, 4, 5, 6, 7, 8, 9]
    assert [r.sample_id for r in hard] == [6, 5, 4, 3, 2, 1, 0]
    assert [r.position for r in hard] == list(range(7))


def test_methods_of_different_size(spark):
    both = ranking(spark, 10, method="a").unionByName(ranking(spark, 4, base=1, method="b"))
    found = S.build_subsets(both, [50]).groupBy("method").count().collect()
    assert {r.method: r["count"] for r in found} == {"a": 5, "b": 2}


def test_unknown_direction(spark):
    with pytest.raises(ValueError, match="direction"):
        S.build_subsets(ranking(spark, 3), [0], "sideways")


def test_audit_means_and_empty_sides(spark):
    rows = ranking(spark, 4).withColumn("score", F.col("rank").cast("double"))
    found = {r.percent_removed: r for r in S.audit_subsets(rows, [0, 50, 100]).collect()}
    assert (found[0].retained, found[0].removed) == (4, 0)
    assert found[0].removed_mean_score is None and found[0].retained_mean_score == 1.5
    assert (found[50].retained_mean_score, found[50].removed_mean_score) == (2.5, 0.5)
    assert found[100].retained_mean_score is None and found[100].removed == 4


def test_budget_lists(spark):
    grid = S.percentile_grid(spark, 0, 20, 10)
    assert [r[0] for r in grid.collect()] == [0, 10, 20]
    assert S.budget_list(0, 90, 10, [0, 33]) == [0, 33]
    assert S.budget_list(0, 25, 10) == [0, 10, 20]
    with pytest.raises(ValueError):
        S.budget_list(0, 90, 0)


def test_picks_of_tiny_tables_are_empty(spark):
    assert S.easy_hard_random(ranking(spark, 3)).count() == 0


def test_picks(spark):
    rows = ranking(spark, 40).withColumn("score", F.col("rank") % 4 + 0.0)
    picks = S.easy_hard_random(rows, limit=3)
    by = {}
    for r in picks.collect():
        by.setdefault(r.category, []).append(r.sample_id)
    assert sorted(by["easy"]) == [0, 4, 8] and sorted(by["hard"]) == [31, 35, 39]
    assert len(by["random"]) == len(set(by["random"])) == 3
    everyone = S.picked_samples(rows, picks)
    assert everyone.count() == len({i for ids in by.values() for i in ids})


def test_lookup_defaults_to_zero(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    scored = spark.createDataFrame([(2, 0.5)], "sample_id long, score double")
    found = {r.sample_id: r.score for r in S.attach_scores(samples, scored).collect()}
    assert found == {1: 0.0, 2: 0.5}


def test_preferred_ranking(spark):
    both = ranking(spark, 2, method="random").unionByName(ranking(spark, 3, method="own"))
    assert {r.method for r in S.preferred_ranking(both).collect()} == {"random"}
    assert {r.method for r in S.preferred_ranking(both, ["own"]).collect()} == {"own"}
    assert {r.method for r in S.preferred_ranking(both, ["own", "random"]).collect()} == {"random"}
    assert S.preferred_ranking(both, ["effective_rank"]).count() == 0
    assert S.preferred_ranking(both, []).count() == 0
