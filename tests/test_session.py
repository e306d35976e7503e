import os

from pyspark.sql import functions as F

from chaffline import session


def joins(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_after_counting(spark):
    big = spark.range(1000).withColumn("v", F.rand(1))
    small = spark.range(50).withColumn("w", F.lit(1))
    hinted = big.join(session.broadcast_if_small(small, 50), "id")
    assert "BroadcastHashJoin" in joins(hinted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in joins(big.join(session.broadcast_if_small(small, 49), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spread_leaves_large_inputs_alone(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 64)
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(few, "id").rdd.getNumPartitions() == cores
    assert session.spread(many, "id") is many


def test_checkpoint_folder_is_the_sessions_own(spark):
    folder = session.checkpoint_folder(spark)
    set_by_session = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert folder == spark.sparkContext.getCheckpointDir()
    if set_by_session:
        assert os.path.basename(set_by_session.rstrip("/")) in folder
    frame = session.cut_lineage(spark.range(5))
    assert frame.count() == 5 and "ExistingRDD" in joins(frame)


def test_no_query_plans_a_cross_join(spark):
    import __spark_entry__ as entry_points

    names = ("stable_rank", "subset_remove_easy", "aggregate_curves", "knn_exact", "scaling_law_fit")
    for name in names:
        plan = joins(entry_points.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
