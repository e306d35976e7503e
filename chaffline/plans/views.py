"""Projections that bind the operators to the given tables, in Spark and as SQL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.session import spread
from chaffline.sources import corpus as source

# Percentages of a corpus that are removed.
BUDGETS = [0, 10, 20, 30, 50, 70, 90]
BLOCK_SIZE = 128


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(value: Column, by: int) -> Column:
    """Integer division."""
    return F.call_function("div", value, F.lit(by))


# Labelled samples ------------------------------------------------------------------------

def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(source.documents(spark, f"{folder}/documents.parquet"), "doc_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).withColumnRenamed("doc_id", "sample_id")


def sample_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with the label, -1 where none is given. The text column is never read."""
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"))
    known = table(spark, folder, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").cast("long").alias("label")
    )
    return ids.join(known, "sample_id", "left").select(
        "sample_id", F.coalesce("label", F.lit(-1)).alias("label")
    )


SAMPLES = """samples AS (
  SELECT d.doc_id AS sample_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS label, d.text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

LABELLED_IDS = "labelled AS (SELECT DISTINCT doc_id AS sample_id FROM labels)"


def labelled_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id")).distinct()


# Feature vectors, hidden states, logits, feature maps --------------------------------------

def features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("features"),
    )


def hidden_states(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        whole(vec, 40).alias("sample_id"),
        (vec % 4).cast("int").alias("layer"),
        whole(vec % 40, 4).cast("int").alias("token_pos"),
        F.col("embedding").alias("vector"),
    )


HIDDEN_STATES = """hidden_states AS (
  SELECT vec_id // 40 AS sample_id, CAST(vec_id % 4 AS INTEGER) AS layer,
         CAST((vec_id % 40) // 4 AS INTEGER) AS token_pos, embedding AS vector
  FROM embeddings)"""


def hidden_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label per sample of the hidden states: the smallest among its rows."""
    return (
        table(spark, folder, "embeddings")
        .groupBy(whole(F.col("vec_id"), 40).alias("sample_id"))
        .agg(F.min("label").cast("long").alias("label"))
    )


LOGITS_WIDTH = 10


def _folded(place: int) -> Column:
    """The sum of a vector's 64 entries whose index is `place` modulo the number of logits."""
    entries = [F.get("embedding", F.lit(i)).cast("double") for i in range(place, 64, LOGITS_WIDTH)]
    return reduce(add, entries)


def logits(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        whole(vec, 10).alias("sample_id"),
        (vec % 3).alias("run"),
        F.lit(0).alias("epoch"),
        F.col("label").cast("long").alias("label"),
        F.array(*[_folded(j) for j in range(LOGITS_WIDTH)]).alias("logits"),
    )


FOLDED_SQL = ", ".join(
    " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(j, 64, LOGITS_WIDTH)) for j in range(LOGITS_WIDTH)
)
LOGITS = f"""logits AS (
  SELECT vec_id, vec_id // 10 AS sample_id, vec_id % 3 AS run, 0 AS epoch,
         CAST(label AS BIGINT) AS label,
         [{FOLDED_SQL}] AS logits
  FROM embeddings)"""


def feature_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 values of a vector as 8 channels of 8 positions."""
    channels: list[Column] = [F.slice("embedding", 8 * c + 1, 8) for c in range(8)]
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.array(*channels).alias("feature_map")
    )


# Prediction log, epoch metrics, run results ------------------------------------------------

def prediction_log(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("event_id") % 3).alias("seed"),
        F.col("user_id").alias("sample_id"),
        F.lit(0).alias("epoch"),
        F.col("event_id").alias("step"),
        (~F.col("event_type").isin("error", "view")).cast("int").alias("correct"),
        "ts",
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return prediction_log(table(spark, folder, "events")).drop("ts")


PREDICTIONS = """predictions AS (
  SELECT event_id % 3 AS seed, user_id AS sample_id, 0 AS epoch, event_id AS step,
         CAST(event_type NOT IN ('error', 'view') AS INTEGER) AS correct
  FROM events)"""


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.col("event_type") != "click"
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("epoch"),
        F.when(shown, F.col("value")).alias("val_acc"),
        F.when(shown, -F.col("value") / 2).alias("val_loss"),
    )


EPOCH_METRICS = """epoch_metrics AS (
  SELECT user_id AS run, event_id AS epoch,
         CASE WHEN event_type <> 'click' THEN value END AS val_acc,
         CASE WHEN event_type <> 'click' THEN -value / 2 END AS val_loss
  FROM events)"""


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    percent = F.get(F.array(*[F.lit(p) for p in BUDGETS]), F.col("l_linenumber") - 1)
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("method"),
        percent.alias("percent_removed"),
        F.col("l_suppkey").alias("seed"),
        (
            F.pow(1 - percent / 100.0, F.lit(0.2)) * 0.9 + (F.col("l_discount") - 0.05) / 10
        ).alias("test_acc"),
        "l_tax",
    )
    return rows.select(
        "method",
        "percent_removed",
        "seed",
        (F.col("test_acc") + 0.01).alias("best_val_acc"),
        (F.lit(3.0) - F.col("test_acc") * 2 + F.col("l_tax") / 10).alias("best_val_loss"),
        "test_acc",
    )


RUN_RESULTS = """run_rows AS (
  SELECT l_returnflag AS method, [0, 10, 20, 30, 50, 70, 90][l_linenumber] AS percent_removed,
         l_suppkey AS seed, l_discount, l_tax
  FROM lineitem),
run_acc AS (
  SELECT *, pow(1 - percent_removed / 100.0::DOUBLE, 0.2::DOUBLE) * 0.9::DOUBLE
            + (l_discount - 0.05::DOUBLE) / 10 AS test_acc
  FROM run_rows),
run_results AS (
  SELECT method, percent_removed, seed, test_acc + 0.01::DOUBLE AS best_val_acc,
         3.0::DOUBLE - test_acc * 2 + l_tax / 10 AS best_val_loss, test_acc
  FROM run_acc)"""
