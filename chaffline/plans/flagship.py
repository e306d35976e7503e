"""Whole ways through the library: from documents to an audited subset, to a best method."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.operators import prep
from chaffline.operators.curves import (
    VALIDATION_ACCURACY,
    aggregate_curves,
    best_method_per_budget,
)
from chaffline.operators.grid import POISSON as POISSON_SQL
from chaffline.operators.grid import evaluation_grid
from chaffline.operators.splits import VALIDATION, stratified_split
from chaffline.operators.subsets import audit_subsets, build_subsets, retained_rows
from chaffline.plans import analysis, ranking, text, vectors
from chaffline.plans.analysis import COUNTS_SQL
from chaffline.plans.ranking import QUALITY_SQL, STRATIFIED_SQL
from chaffline.plans.views import SAMPLES, labelled_ids, prediction_log, sample_labels, texts
from chaffline.scorers.base import rank_together
from chaffline.scorers.registry import get_scorer
from chaffline.session import checkpoint_folder, cut_lineage
from chaffline.streaming import forgetting as streaming

GRID_BUDGETS = [0, 30, 70]
GRID_SEEDS = [32, 33]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    ranked = get_scorer("heuristic_filtering").score(
        texts(spark, folder), sample_labels(spark, folder)
    )
    return audit_subsets(ranked, [30])


def labelled_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of the labelled documents, apart by split, and the train texts."""
    ids = labelled_ids(spark, folder)
    labels = retained_rows(sample_labels(spark, folder), ids)
    chosen = retained_rows(texts(spark, folder), ids)
    every = sample_labels(spark, folder)
    split = cut_lineage(stratified_split(every, int(every.count() * 0.2)))
    rows = cut_lineage(prep.text_features(chosen).join(labels, "sample_id"))
    of_validation = split.filter(F.col("split") == VALIDATION)
    of_train = split.filter(F.col("split") != VALIDATION)
    return retained_rows(rows, of_train), retained_rows(rows, of_validation), retained_rows(chosen, of_train)


def grid_runs(spark: SparkSession, folder: str, methods: list[str], model: str = "bayes") -> DataFrame:
    train, validation, train_texts = labelled_parts(spark, folder)
    labels = train.select("sample_id", "label")
    inputs = {"random": labels, "heuristic_filtering": train_texts, "semantic_dedup": train}
    ranked = rank_together([get_scorer(m).scores(inputs[m], labels) for m in methods])
    subsets = cut_lineage(build_subsets(ranked, GRID_BUDGETS))
    return evaluation_grid(train, validation, subsets, GRID_SEEDS, model=model)


def grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid_runs(spark, folder, ["random", "heuristic_filtering"])


def logistic_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The same grid with logistic regressions, all cells fitted side by side."""
    runs = grid_runs(spark, folder, ["random", "heuristic_filtering"], "logistic")
    return runs.select(
        "method", "percent_removed", "seed", *[F.round(c, 3).alias(c) for c in ("best_val_acc", "best_val_loss", "test_acc")]
    )


def corpus_to_best_method(spark: SparkSession, folder: str) -> DataFrame:
    """Text, features, scores, subsets, runs, curves, best method: all in one go."""
    runs = grid_runs(spark, folder, ["random", "heuristic_filtering", "semantic_dedup"])
    return best_method_per_budget(aggregate_curves(runs), VALIDATION_ACCURACY)


def streaming_forgetting_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The prediction log read as a stream until it is used up."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    place = f"{checkpoint_folder(spark)}/streaming-{uuid.uuid4().hex}"
    streaming.start_forgetting(prediction_log(events), place).awaitTermination()
    return streaming.read_forgetting_counts(spark, place)


# Parts of the log, a batch each, and rows of one of its files at most (about).
STREAM_FILES = 6
FILE_ROWS = 500_000


def streaming_forgetting_late(spark: SparkSession, folder: str) -> DataFrame:
    """The same log dealt into parts whose steps interleave, one part a batch, the last steps first.

    A part is one file, or as many as its rows ask for; the number of batches does not grow with them.
    """
    place = f"{checkpoint_folder(spark)}/streaming-{uuid.uuid4().hex}"
    log = prediction_log(spark.read.parquet(f"{folder}/events.parquet")).drop("ts")
    files = max(1, math.ceil(log.count() / STREAM_FILES / FILE_ROWS))
    for part in range(STREAM_FILES):
        own = log.filter(F.pmod(F.xxhash64("step"), F.lit(STREAM_FILES)) == STREAM_FILES - 1 - part)
        own = own.repartitionByRange(files, F.desc("step")).sortWithinPartitions(F.desc("step"))
        own.write.mode("append").parquet(f"{place}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/log")
    streaming.start_forgetting(stream, place).awaitTermination()
    return streaming.read_forgetting_counts(spark, place)


FEATURES_SQL = """grams AS (
  SELECT doc_id AS sample_id,
         unnest(list_transform(range(1, length(text) - 1),
                lambda i: chars[i] || chars[i + 1] || chars[i + 2])) AS gram
  FROM (SELECT doc_id, text, string_split(text, '') AS chars FROM documents
        SEMI JOIN labels USING (doc_id))),
counts AS (
  SELECT sample_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS bucket,
         CAST(count(*) AS DOUBLE) AS n
  FROM grams GROUP BY ALL),
found AS (
  SELECT sample_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY sample_id)) AS value FROM counts),
dense AS (
  SELECT sample_id, bucket, coalesce(value, 0.0::DOUBLE) AS x
  FROM (SELECT DISTINCT doc_id AS sample_id, unnest(range(64)) AS bucket FROM labels)
  SEMI JOIN samples USING (sample_id) LEFT JOIN found USING (sample_id, bucket))"""

ORDERS = {
    "random": "SELECT sample_id, md5(concat_ws('|', '777', sample_id)) AS score FROM train",
    "heuristic_filtering": "SELECT sample_id, score FROM quality SEMI JOIN train USING (sample_id)",
    "semantic_dedup": """SELECT a.sample_id,
        CAST(round(1 - max(list_dot_product(a.v, b.v)), 6) AS FLOAT) AS score
      FROM lists a JOIN lists b ON a.sample_id <> b.sample_id GROUP BY a.sample_id""",
}


def grid_sql(methods: list[str]) -> str:
    """Gaussian naive Bayes on every (method, budget), measured on the validation rows."""
    ranked = " UNION ALL ".join(
        f"""SELECT '{m}' AS method, sample_id,
              row_number() OVER (ORDER BY score, sample_id) - 1 AS rank FROM ({ORDERS[m]})"""
        for m in methods
    )
    return f"""{SAMPLES}, {QUALITY_SQL}, {FEATURES_SQL},
split AS ({STRATIFIED_SQL.replace(SAMPLES + ",", "", 1)}),
rows_ AS (
  SELECT sample_id, label, split FROM samples JOIN split USING (sample_id)
  SEMI JOIN (SELECT doc_id AS sample_id FROM labels) USING (sample_id)),
train AS (SELECT sample_id, label FROM rows_ WHERE split = 'train'),
val AS (SELECT sample_id, label FROM rows_ WHERE split = 'val'),
lists AS (
  SELECT sample_id, list(x ORDER BY bucket) AS v FROM dense SEMI JOIN train USING (sample_id)
  GROUP BY sample_id),
ranking AS ({ranked}),
members AS (
  SELECT method, percent_removed, sample_id, label FROM (
    SELECT *, unnest({GRID_BUDGETS}) AS percent_removed FROM ranking, (SELECT count(*) AS n FROM train))
  JOIN train USING (sample_id) WHERE rank >= n * percent_removed // 100),
drawn AS (
  SELECT *, {' + '.join(f"CAST(u >= {p} AS INTEGER)" for p in POISSON_SQL)} AS w FROM (
    SELECT *, ('0x' || substr(md5(concat_ws('|', seed, sample_id)), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
    FROM (SELECT *, CAST(unnest({GRID_SEEDS}) AS BIGINT) AS seed FROM members))),
sums AS (
  SELECT method, percent_removed, seed, label, bucket, sum(w) AS n, sum(w * x) AS s, sum(w * x * x) AS q
  FROM drawn JOIN dense USING (sample_id) WHERE w > 0 GROUP BY ALL),
spread AS (
  SELECT method, percent_removed, seed, max(variance) * 1e-9::DOUBLE AS eps FROM (
    SELECT method, percent_removed, seed, sum(q) / sum(n) - pow(sum(s) / sum(n), 2) AS variance
    FROM sums GROUP BY method, percent_removed, seed, bucket) GROUP BY ALL),
params AS (
  SELECT method, percent_removed, seed, label AS class, bucket, s / n AS mean,
         q / n - pow(s / n, 2) + eps AS variance,
         ln(n / CAST(sum(n) OVER (PARTITION BY method, percent_removed, seed, bucket) AS DOUBLE)) AS prior
  FROM sums JOIN spread USING (method, percent_removed, seed)),
likelihoods AS (
  SELECT method, percent_removed, seed, val.sample_id, val.label, class,
         any_value(prior) - sum(pow(x - mean, 2) / variance + ln(2 * pi() * variance)) / 2 AS ll
  FROM val JOIN dense USING (sample_id) JOIN params USING (bucket) GROUP BY ALL),
shares AS (
  SELECT *, exp(ll - max(ll) OVER w) / sum(exp(ll - top)) OVER w AS p,
         row_number() OVER (w ORDER BY ll DESC, class) AS place
  FROM (SELECT *, max(ll) OVER (PARTITION BY method, percent_removed, seed, sample_id) AS top FROM likelihoods)
  WINDOW w AS (PARTITION BY method, percent_removed, seed, sample_id)),
runs AS (
  SELECT method, percent_removed, seed,
         avg(CAST(class = label AS INTEGER)) FILTER (place = 1) AS best_val_acc,
         sum(-ln(greatest(p, 1e-12::DOUBLE))) FILTER (class = label)
           / (SELECT count(*) FROM val) AS best_val_loss
  FROM shares GROUP BY method, percent_removed, seed)"""


#: Every method with a table to feed it and SQL to check it, by its query; the two spectral ones rank from 1.
RANKED = {
    "heuristic_filtering": ranking.QUERIES["rank_heuristic"],
    "random": ranking.QUERIES["rank_random"],
    "perplexity_filtering": text.QUERIES["rank_perplexity"],
    "llm_classifier": vectors.QUERIES["rank_entropy"],
    "semantic_dedup": vectors.QUERIES["rank_semantic_dedup"],
    "forgetting_events": analysis.QUERIES["rank_forgetting"],
    "intrinsic_dimensionality_twonn": vectors.QUERIES["rank_intrinsic_dim"],
    "corr_integral": vectors.QUERIES["rank_corr_integral"],
    "effective_rank": vectors.QUERIES["rank_effective_rank"],
}


def rank_every_method(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of all these methods ranked together, one-based where the method is."""
    scores = [
        query(spark, folder).select("sample_id", "label", "score", "method") for query, _ in RANKED.values()
    ]
    return rank_together(scores, {"corr_integral": 1, "effective_rank": 1})


def rounded_grid(spark: SparkSession, folder: str) -> DataFrame:
    runs = grid(spark, folder)
    return runs.withColumns({c: F.round(c, 5) for c in ("best_val_acc", "best_val_loss")})


QUERIES = {
    "rank_every_method": (
        rank_every_method,
        " UNION ALL ".join(
            f"SELECT sample_id, label, score, rank, method FROM ({sql})" for _, sql in RANKED.values()
        ),
    ),
    "evaluation_grid": (
        rounded_grid,
        f"""WITH {grid_sql(["random", "heuristic_filtering"])}
        SELECT method, percent_removed, seed, round(best_val_acc, 5) AS best_val_acc,
               round(best_val_loss, 5) AS best_val_loss, 'nan'::DOUBLE AS test_acc FROM runs""",
    ),
    "evaluation_grid_logistic": (logistic_grid, None),
    "corpus_to_best_method": (
        corpus_to_best_method,
        f"""WITH {grid_sql(["random", "heuristic_filtering", "semantic_dedup"])}
        SELECT percent_removed, method
        FROM (SELECT method, percent_removed, avg(best_val_acc) AS best_val_acc FROM runs GROUP BY ALL)
        WHERE percent_removed <> 0
        QUALIFY row_number() OVER (PARTITION BY percent_removed ORDER BY best_val_acc DESC, method) = 1""",
    ),
    "streaming_forgetting_counts": (
        streaming_forgetting_counts,
        f"WITH {COUNTS_SQL} SELECT * FROM counts",
    ),
    "streaming_forgetting_late": (
        streaming_forgetting_late,
        f"WITH {COUNTS_SQL} SELECT * FROM counts",
    ),
}
