import json
import math
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chaffline.operators import curves as C
from chaffline.operators.grid import evaluation_grid
from chaffline.operators.splits import random_split
from chaffline.operators.subsets import build_subsets
from chaffline.scorers.base import RANKING_SCHEMA
from chaffline.sources import artifacts as A
from chaffline.sources import runs
from chaffline.sources.corpus import documents, text_files


def ranking(spark, n=2000, method="m"):
    return spark.range(n).select(
        F.col("id").alias("sample_id"),
        (F.col("id") % 10).alias("label"),
        (F.col("id") / n).alias("score"),
        F.col("id").alias("rank"),
        F.lit(method).alias("method"),
    )


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo é😀", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x", encoding="utf-8")
    found = text_files(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in found) == ["one\ntwo é😀", "x"]
    assert len({r.doc_id for r in found}) == 2


def test_document_scan_reads_two_columns(spark):
    plan = documents(spark, "/root/testdata/sf0.001/documents.parquet")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_rankings_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    both = ranking(spark, 20).unionByName(ranking(spark, 30, "other"))
    A.save_rankings(both, folder, "corpus", {"b": 1, "a": [2]})
    back = A.read_rankings(spark, folder, "other")
    assert back.schema.names == RANKING_SCHEMA.names and back.count() == 30
    meta = {r.method: r for r in spark.read.json(f"{folder}/metadata").collect()}
    assert meta["m"].num_samples == 20 and meta["m"].dataset == "corpus"
    assert json.loads(meta["m"].config) == {"a": [2], "b": 1}
    assert spark.read.csv(f"{folder}/scores_csv", header=True).count() == 50


def test_missing_rankings_are_errors(spark, tmp_path):
    with pytest.raises(AnalysisException):
        A.read_rankings(spark, str(tmp_path / "none"))
    A.save_rankings(ranking(spark, 5), str(tmp_path / "some"))
    with pytest.raises(FileNotFoundError, match="other"):
        A.read_rankings(spark, str(tmp_path / "some"), "other")


def test_a_stored_split_wins(spark, tmp_path):
    ids = spark.range(100).withColumnRenamed("id", "sample_id")
    path = str(tmp_path / "split")
    calls = []

    def create(seed):
        calls.append(seed)
        return random_split(ids, 0.1, seed)

    first = A.load_or_create_split(spark, path, create, 1)
    again = A.load_or_create_split(spark, path, create, 2)
    assert calls == [1]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert {r.split_seed for r in again.collect()} == {1}


def test_subsets_round_trip_and_pruning(spark, tmp_path):
    folder = str(tmp_path / "subsets")
    A.save_subsets(build_subsets(ranking(spark), [0, 5]), folder, rows_per_file=600)
    back = A.read_subsets(spark, folder)
    files = list((tmp_path / "subsets" / "method=m" / "percent_removed=5").glob("*.parquet"))
    assert 1 <= len(files) <= 4
    five = back.filter("method = 'm' and percent_removed = 5")
    assert five.count() == 1900
    plan = five._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(method" in plan
    manifest = A.subset_manifest(back).orderBy("percent_removed").collect()
    assert [(r.percent_removed, r.path) for r in manifest] == [
        (0, "method=m/percent_removed=0"),
        (5, "method=m/percent_removed=5"),
    ]


def test_nested_subsets_are_stored_once(spark, tmp_path):
    """Every budget reads back as it was built, from one row a sample and a pushed range of places."""
    folder, budgets = str(tmp_path / "nested"), [0, 5, 30, 100]
    rows = ranking(spark)
    other = rows.withColumn("method", F.lit("z"))
    for direction in ("remove_easy", "remove_hard"):
        A.save_nested_subsets(rows, budgets, folder, direction)
    A.save_nested_subsets(other, [30, 50], folder)
    A.save_nested_subsets(rows, budgets, folder)  # again; the other method and direction stay
    n = rows.count()
    stored = spark.read.parquet(f"{folder}/places").groupBy("method", "direction").count().collect()
    assert {(r.method, r.direction): r["count"] for r in stored} == {
        ("m", "remove_easy"): n, ("m", "remove_hard"): n, ("z", "remove_easy"): n - n * 30 // 100,
    }
    key = lambda frame: sorted(map(tuple, frame.select("method", "percent_removed", "position", "sample_id").collect()))
    every = A.read_nested_subsets(spark, folder)
    for direction in ("remove_easy", "remove_hard"):
        built = build_subsets(rows, budgets, direction)
        assert key(every.where((F.col("method") == "m") & (F.col("direction") == direction))) == key(built)
        one = A.read_nested_subset(spark, folder, "m", 30, direction)
        assert key(one) == key(built.where("percent_removed = 30"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(place,{n * 30 // 100})" in plan
    with pytest.raises(FileNotFoundError):
        A.read_nested_subset(spark, folder, "m", 31)


def test_a_second_method_leaves_the_first(spark, tmp_path):
    folder = str(tmp_path / "two")
    first, second = ranking(spark, 20), ranking(spark, 30).withColumn("method", F.lit("other"))
    for own in (first, second):
        A.save_rankings(own, f"{folder}/rankings", "corpus")
        A.save_subsets(build_subsets(own, [0, 50]), f"{folder}/subsets")
    assert A.read_rankings(spark, f"{folder}/rankings").groupBy("method").count().count() == 2
    assert spark.read.json(f"{folder}/rankings/metadata").count() == 2
    assert spark.read.csv(f"{folder}/rankings/scores_csv", header=True).count() == 50
    assert {(r[0], r[1]): r[2] for r in A.read_subsets(spark, f"{folder}/subsets").groupBy("method", "percent_removed").count().collect()} == {
        ("m", 0): 20, ("m", 50): 10, ("other", 0): 30, ("other", 50): 15,
    }


def write_run(root, method, p, seed, test_acc):
    folder = root / method / f"p{p:02d}" / f"seed{seed}"
    folder.mkdir(parents=True)
    text = json.dumps(
        {
            "method": method,
            "percent_removed": p,
            "seed": seed,
            "best_val_acc": 0.9,
            "best_val_loss": 0.3,
            "test_acc": test_acc,
        },
        indent=2,
    )
    (folder / "run_summary.json").write_text(text)


def test_many_files_are_few_tasks(spark, tmp_path):
    for p in range(0, 60, 5):
        for seed in range(25):
            write_run(tmp_path, "m", p, seed, 0.5 + p / 1000)
    (tmp_path / "m" / "notes.json").write_text("not a summary")
    files = runs.run_files(spark, str(tmp_path), files_per_task=100)
    assert files.rdd.getNumPartitions() == 3 and files.count() == 300
    assert A.read_run_summaries(spark, f"file://{tmp_path}").count() == 300


def test_compaction_takes_what_is_new(spark, tmp_path):
    root, table = tmp_path / "runs", str(tmp_path / "table")
    assert runs.compacted_runs(spark, table).collect() == []
    write_run(root, "m", 0, 1, 0.5)
    write_run(root, "m", 5, 1, float("nan"))
    assert [runs.compact_runs(spark, str(root), table) for _ in range(2)] == [2, 0]
    write_run(root, "n", 0, 1, 0.7)
    changed = root / "m" / "p00" / "seed1" / "run_summary.json"
    changed.write_text(changed.read_text().replace("0.5", "0.75"))
    os.utime(changed, (2e9, 2e9))
    assert runs.compact_runs(spark, str(root), table) == 2
    found = {(r.method, r.percent_removed): r.test_acc for r in runs.compacted_runs(spark, table).collect()}
    assert found["m", 0] == 0.75 and math.isnan(found["m", 5]) and found["n", 0] == 0.7 and len(found) == 3


def test_a_broken_summary_is_named(spark, tmp_path):
    write_run(tmp_path, "m", 0, 1, 0.5)
    (tmp_path / "m" / "p00" / "seed1" / "run_summary.json").write_text("{")
    with pytest.raises(Exception, match="p00/seed1/run_summary.json is no run summary"):
        A.read_run_summaries(spark, str(tmp_path)).collect()


def test_run_summaries(spark, tmp_path):
    assert A.read_run_summaries(spark, str(tmp_path)).schema == C.RUN_SCHEMA
    assert A.read_run_summaries(spark, str(tmp_path)).count() == 0
    for p, seed, acc in ((0, 101, 0.89), (0, 202, float("nan")), (5, 101, 0.87)):
        write_run(tmp_path, "random", p, seed, acc)
    runs = A.read_run_summaries(spark, str(tmp_path))
    assert runs.count() == 3 and runs.filter(F.isnan("test_acc")).count() == 1
    curve = {r.percent_removed: r for r in C.aggregate_curves(runs).collect()}
    assert curve[0].test_acc_mean == 0.89 and curve[0].n_seeds == 2
    A.append_runs(runs, str(tmp_path / "table"))
    A.append_runs(runs, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    A.save_run_table(runs, str(tmp_path / "csv"))
    back = spark.read.schema(C.RUN_SCHEMA).csv(str(tmp_path / "csv"), header=True)
    assert [(r.percent_removed, r.seed) for r in back.collect()] == [(0, 101), (0, 202), (5, 101)]


@pytest.mark.parametrize("suffix", ["", "_epoch"])
def test_epoch_metrics_under_either_naming(spark, tmp_path, suffix):
    (tmp_path / "metrics.csv").write_text(
        f"epoch,step,train_loss,val_acc{suffix},val_loss{suffix}\n0,9,1.5,,\n0,9,,0.7,0.9\n1,19,,0.8,\n"
    )
    rows = A.read_epoch_metrics(spark, str(tmp_path)).orderBy("epoch", "val_acc").collect()
    assert [(r.epoch, r.val_acc, r.val_loss) for r in rows] == [(0, None, None), (0, 0.7, 0.9), (1, 0.8, None)]
    assert rows[0].run.endswith("metrics.csv")


def test_epoch_metrics_of_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("epoch,val_loss\n0,0.5\n")
    (tmp_path / "b.csv").write_text("val_acc,epoch\r\n0.25,7\r\n")
    (tmp_path / "c.csv").write_text("step,val_acc_epoch,val_acc,epoch\n3,0.9,0.1,2\n4,,0.2,3\n")
    (tmp_path / "d.csv").write_text('note,epoch,val_acc\n"a, ""b""",4,0.5\n')
    rows = A.read_epoch_metrics(spark, str(tmp_path)).collect()
    found = sorted((r.run[-5:], r.epoch, r.val_acc, r.val_loss) for r in rows)
    assert found == [
        ("a.csv", 0, None, 0.5), ("b.csv", 7, 0.25, None), ("c.csv", 2, 0.9, None), ("c.csv", 3, None, None),
        ("d.csv", 4, 0.5, None),
    ]


def test_an_empty_folder_is_no_stored_split(spark, tmp_path):
    ids = spark.range(100).withColumnRenamed("id", "sample_id")
    (tmp_path / "split").mkdir()
    made = A.load_or_create_split(spark, str(tmp_path / "split"), lambda seed: random_split(ids, 0.1, seed), 3)
    assert made.count() == 100
    again = A.load_or_create_split(spark, str(tmp_path / "split"), None, 4)
    assert {r.split_seed for r in again.collect()} == {3}


def test_curves_fits_and_conclusions_are_written(spark, tmp_path):
    rows = [("m", p, s, 0.5, 0.5, 0.9 - p / 200 + s / 1000) for p in (0, 10, 30) for s in (1, 2)]
    runs = spark.createDataFrame(rows, C.RUN_SCHEMA)
    curve = C.aggregate_curves(runs)
    metric = C.primary_metric("accuracy")
    A.save_curves(curve, str(tmp_path))
    A.save_fits(C.fit_scaling_law(curve, metric), str(tmp_path))
    A.save_conclusions(C.conclusion_lines(curve, metric), str(tmp_path))
    back = spark.read.csv(f"{tmp_path}/curve_metrics_csv", header=True, inferSchema=True)
    assert [r.percent_removed for r in back.collect()] == [0, 10, 30]
    assert spark.read.json(f"{tmp_path}/curve_metrics_json").count() == 3
    assert spark.read.json(f"{tmp_path}/scaling_law_fits").first().method == "m"
    text = [r.value for r in spark.read.text(f"{tmp_path}/conclusions").collect()]
    assert text[1].startswith("QUANTITATIVE") and text[-1] == "=" * 70


def test_grid_of_runs(spark):
    rows = spark.range(60).select(
        F.col("id").alias("sample_id"),
        (F.col("id") % 2).alias("label"),
        F.array((F.col("id") % 2) * 4.0 + F.col("id") % 3, F.col("id") % 5 + 0.0).alias("features"),
    )
    train, validation = rows.filter("sample_id < 40"), rows.filter("sample_id >= 40")
    subsets = build_subsets(ranking(spark, 40), [0, 50])
    runs = evaluation_grid(train, validation, subsets, [1, 2])
    assert runs.schema == C.RUN_SCHEMA and runs.count() == 4
    for r in runs.collect():
        assert r.best_val_acc == 1.0 and r.best_val_loss < 0.1 and math.isnan(r.test_acc)
    tested = evaluation_grid(train, validation, subsets, [1], test=validation)
    assert {r.test_acc for r in tested.collect()} == {1.0}


def test_seeds_of_the_grid_matter_and_estimators_are_looped_over(spark):
    from pyspark.ml.classification import NaiveBayes

    rows = spark.range(200).select(
        F.col("id").alias("sample_id"),
        (F.col("id") % 2).alias("label"),
        F.array((F.col("id") % 2) + F.col("id") % 7 + 0.0, F.col("id") % 5 + 0.0).alias("features"),
    )
    train, validation = rows.filter("sample_id < 150"), rows.filter("sample_id >= 150")
    subsets = build_subsets(ranking(spark, 150), [0, 50])
    runs = evaluation_grid(train, validation, subsets, [1, 2, 3]).collect()
    assert len({r.best_val_loss for r in runs if r.percent_removed == 0}) == 3
    again = evaluation_grid(train, validation, subsets, [1, 2, 3]).collect()
    assert sorted(map(str, runs)) == sorted(map(str, again))
    looped = evaluation_grid(train, validation, subsets, [1, 2], lambda seed: NaiveBayes(modelType="gaussian"))
    assert looped.count() == 4
