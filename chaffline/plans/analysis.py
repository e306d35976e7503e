"""Queries over prediction logs, epoch metrics and run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaffline.operators import curves as C
from chaffline.operators import metrics
from chaffline.plans.views import (
    BUDGETS,
    EPOCH_METRICS,
    PREDICTIONS,
    RUN_RESULTS,
    epoch_metrics,
    predictions,
    run_results,
)
from chaffline.scorers import forgetting as G
from chaffline.scorers.registry import get_scorer
from chaffline.session import cut_lineage
from chaffline.sources.artifacts import run_table, subset_manifest

METRIC = C.primary_metric("accuracy")
LOSS = C.primary_metric("loss")
CROP = [0, 10, 20, 30]


def rounded(frame, digits=6, **other):
    """All double columns rounded, some to their own number of digits."""
    return frame.select(
        *[
            F.round(c, other.get(c, digits)).alias(c) if kind == "double" else F.col(c)
            for c, kind in frame.dtypes
        ]
    )


# Forgetting -------------------------------------------------------------------------------

COUNTS_SQL = f"""{PREDICTIONS},
steps AS (
  SELECT *, lag(correct, 1, 0) OVER (PARTITION BY seed, sample_id ORDER BY epoch, step) > correct AS fell
  FROM predictions),
counts AS (
  SELECT seed, sample_id, count(*) FILTER (fell) AS forgetting, max(correct) = 1 AS ever_learnt
  FROM steps GROUP BY seed, sample_id)"""
ENSEMBLE_SQL = f"""{COUNTS_SQL},
means AS (
  SELECT sample_id,
         CAST(sum(forgetting) / CAST((SELECT count(DISTINCT seed) FROM counts) AS DOUBLE) AS FLOAT) AS mean,
         count(*) FILTER (NOT ever_learnt) = (SELECT count(DISTINCT seed) FROM counts) AS never_learnt
  FROM counts GROUP BY sample_id),
ensemble AS (
  SELECT sample_id, never_learnt, CAST(CASE WHEN never_learnt
           THEN CAST((SELECT max(mean) FROM means) + 1 AS FLOAT) ELSE mean END AS DOUBLE) AS score
  FROM means)"""


def counts(spark, folder):
    return G.forgetting_counts(predictions(spark, folder))


def ensemble(spark, folder):
    return G.forgetting_ensemble(cut_lineage(counts(spark, folder)))


def rank_forgetting(spark, folder):
    """The label of a sample is its number of log rows."""
    log = predictions(spark, folder)
    labels = log.groupBy("sample_id").agg(F.count(F.lit(1)).alias("label"))
    return get_scorer("forgetting_events").score(log, labels)


def forgetting_histogram(spark, folder):
    """By the gap rule and by the flag."""
    scores = cut_lineage(ensemble(spark, folder))
    by_gap = G.forgetting_histogram(scores).withColumn("rule", F.lit("gap"))
    by_flag = G.forgetting_histogram(scores, "never_learnt").withColumn("rule", F.lit("flag"))
    return by_gap.unionByName(by_flag)


def histogram_sql(rule, never):
    return f"""SELECT '{rule}' AS rule, events, count(score) AS n, false AS never_learnt
    FROM (SELECT unnest(range(CAST(ceil(max(score)) AS BIGINT) + 1)) AS events
          FROM ensemble, tops WHERE NOT {never})
    LEFT JOIN (SELECT CAST(floor(score + 0.5::DOUBLE) AS BIGINT) AS events, score
               FROM ensemble, tops WHERE NOT {never}) USING (events)
    GROUP BY events
    UNION ALL
    SELECT '{rule}', NULL, count(*), true FROM ensemble, tops WHERE {never} HAVING count(*) > 0"""


HISTOGRAM_SQL = f"""WITH {ENSEMBLE_SQL},
tops AS (
  SELECT max(score) AS top, max(score) FILTER (score < (SELECT max(score) FROM ensemble)) AS next
  FROM ensemble)
{histogram_sql('gap', '(coalesce(top > next + 0.5::DOUBLE, false) AND score = top)')}
UNION ALL
{histogram_sql('flag', 'never_learnt')}"""


def forgetting_sorted(spark, folder):
    return G.forgetting_sorted(ensemble(spark, folder))


def forgetting_statistics(spark, folder):
    return rounded(G.forgetting_statistics(ensemble(spark, folder)))


# Curves -----------------------------------------------------------------------------------

CURVES_SQL = f"""{RUN_RESULTS},
curves AS (
  SELECT method, percent_removed, avg(best_val_acc) AS val_acc_mean,
         stddev_samp(best_val_acc) AS val_acc_std, avg(best_val_loss) AS val_loss_mean,
         stddev_samp(best_val_loss) AS val_loss_std, avg(test_acc) AS test_acc_mean,
         stddev_samp(test_acc) AS test_acc_std, count(seed) AS n_seeds,
         1 - percent_removed / 100::DOUBLE AS retention
  FROM run_results GROUP BY method, percent_removed)"""


def curves(spark, folder):
    return C.aggregate_curves(run_results(spark, folder))


def held_curves(spark, folder):
    """The curves written out: a few rows that several branches of a plan read."""
    return cut_lineage(curves(spark, folder))


CURVE_COLUMNS = """method, percent_removed, n_seeds, round(val_acc_mean, 6) AS val_acc_mean,
  round(val_acc_std, 6) AS val_acc_std, round(val_loss_mean, 6) AS val_loss_mean,
  round(val_loss_std, 6) AS val_loss_std, round(test_acc_mean, 6) AS test_acc_mean,
  round(test_acc_std, 6) AS test_acc_std, round(retention, 6) AS retention"""


def grid_sql(source, condition, parts, points):
    return f"""
  SELECT method, b, regr_slope(y, x) AS a, regr_intercept(y, x) AS c, regr_r2(y, x) AS r2
  FROM (SELECT method, b, y, pow(retention, b) AS x FROM (
    SELECT p.method, retention, test_acc_mean AS y, i / CAST({parts} AS DOUBLE) AS b
    FROM curves p, {source} WHERE {condition})) WHERE b <> 0 GROUP BY method, b"""


FITS_SQL = f"""{CURVES_SQL},
coarse AS ({grid_sql('(SELECT unnest(range(-2000, 2001)) AS i)', 'true', 100, 'curves')}),
near AS (SELECT method, CAST(round(arg_max(b, r2) * 10000) AS BIGINT) AS centre FROM coarse GROUP BY method),
fine AS ({grid_sql('(SELECT method AS m, unnest(range(centre - 100, centre + 101)) AS i FROM near)',
                   'm = p.method AND abs(i) <= 200000', 10000, 'curves')}),
fits AS (
  SELECT method, arg_max(a, r2) AS a, arg_max(b, r2) AS b, arg_max(c, r2) AS c, max(r2) AS r2
  FROM fine GROUP BY method)"""


def fits(spark, folder):
    return C.fit_scaling_law(held_curves(spark, folder), METRIC)


def scaling_law_fit(spark, folder):
    return rounded(fits(spark, folder), 4)


def scaling_law_curve(spark, folder):
    held = held_curves(spark, folder)
    return rounded(C.scaling_law_curve(held, C.fit_scaling_law(held, METRIC)), 5)


BASELINE_SQL = f"""{CURVES_SQL},
based AS (
  SELECT *, max(test_acc_mean) FILTER (percent_removed = 0) OVER (PARTITION BY method) AS baseline,
         max(val_loss_mean) FILTER (percent_removed = 0) OVER (PARTITION BY method) AS loss_baseline,
         max(test_acc_mean) OVER (PARTITION BY method) AS best
  FROM curves)"""
ANALYSIS_SQL = f"""{BASELINE_SQL},
analysis AS (
  SELECT method, percent_removed, retention * 100 AS retention_pct, baseline AS baseline_value,
         test_acc_mean AS metric_value,
         round_even(test_acc_mean / baseline * 100, 2) AS relative_pct,
         round_even((1 - test_acc_mean / baseline) * 100, 2) AS drop_pct
  FROM based WHERE baseline IS NOT NULL),
safe AS (
  SELECT method, max(percent_removed) FILTER (drop_pct < 2) AS percent_removed,
         min(retention_pct) FILTER (drop_pct < 2) AS retention_pct,
         arg_min(drop_pct, retention_pct) FILTER (drop_pct < 2) AS drop_pct
  FROM analysis GROUP BY method),
best AS (
  SELECT percent_removed, method FROM curves WHERE percent_removed <> 0
  QUALIFY row_number() OVER (PARTITION BY percent_removed ORDER BY test_acc_mean DESC, method) = 1)"""


def budget_analysis(spark, folder):
    return rounded(C.budget_analysis(curves(spark, folder), METRIC))


def budget_analysis_loss(spark, folder):
    return rounded(C.budget_analysis(curves(spark, folder), LOSS))


def conclusion_lines(spark, folder):
    return C.conclusion_lines(held_curves(spark, folder), METRIC)


def one_decimal_sql(x):
    """printf('%.1f') of a number with two decimals, rounded as C does."""
    return f"printf('%.1f', {x})"


NICE = "upper(substr(method, 1, 1)) || lower(substr(method, 2))"
CONCLUSIONS_SQL = f"""WITH {ANALYSIS_SQL}, {FITS_SQL.split(CURVES_SQL)[1].lstrip(', ')}
SELECT '0' AS section, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ordinal, unnest(l) AS line
FROM (SELECT [repeat('=', 70), 'QUANTITATIVE CONCLUSIONS — DATA EFFICIENCY ANALYSIS', repeat('=', 70),
              'Metric: test_acc_mean', 'Direction: higher is better', ''] AS l)
UNION ALL
SELECT '1 ' || method, CAST(generate_subscripts(l, 1) - 1 AS INTEGER), unnest(l)
FROM (SELECT method, ['--- ' || {NICE} || ' ---',
  printf('  Baseline (100%% data): %.4f', baseline_value),
  printf('  Scaling law: test_acc_mean = %.4f * retention^%.4f + %.4f', a, b, c),
  '  Scaling law R²: ' || CAST(round_even(r2, 4) AS VARCHAR), '  Performance at each budget:'] AS l
  FROM analysis JOIN fits USING (method) WHERE percent_removed = 0)
UNION ALL
SELECT '1 ' || method, CAST(200 - percent_removed AS INTEGER),
  printf('    %5.0f%% data → %.4f (%s%% of baseline, drop=%s%%)', retention_pct, metric_value,
         {one_decimal_sql('relative_pct')}, {one_decimal_sql('drop_pct')})
FROM analysis
UNION ALL
SELECT '1 ' || method, 300, CASE WHEN retention_pct IS NULL
  THEN '  No budget achieves <2% performance drop.'
  ELSE printf('  Most aggressive safe budget (<2%% drop): %.0f%% data (drop=%s%%)', retention_pct,
              {one_decimal_sql('drop_pct')}) END
FROM safe
UNION ALL SELECT '1 ' || method, 301, '' FROM (SELECT DISTINCT method FROM analysis)
UNION ALL SELECT '2', 0, '--- Best Method per Budget ---'
UNION ALL
SELECT '2', CAST(200 - percent_removed AS INTEGER),
  printf('  %.0f%% retention → ', CAST(100 - percent_removed AS DOUBLE)) || {NICE} FROM best
UNION ALL SELECT '3', 0, repeat('=', 70)"""

QUERIES = {
    "forgetting_counts": (counts, f"WITH {COUNTS_SQL} SELECT * FROM counts"),
    "forgetting_ensemble": (ensemble, f"WITH {ENSEMBLE_SQL} SELECT * FROM ensemble"),
    "rank_forgetting": (
        rank_forgetting,
        f"""WITH {ENSEMBLE_SQL}
        SELECT sample_id, label, score, row_number() OVER (ORDER BY score, sample_id) - 1 AS rank,
               'forgetting_events' AS method
        FROM ensemble JOIN (SELECT sample_id, count(*) AS label FROM predictions GROUP BY 1) USING (sample_id)""",
    ),
    "forgetting_stats": (
        forgetting_statistics,
        f"""WITH {ENSEMBLE_SQL}
        SELECT count(*) AS n_samples, count(*) FILTER (score = 0) AS n_unforgettable,
               count(*) FILTER (never_learnt) AS n_never_learnt,
               round(count(*) FILTER (score = 0) * 100 / CAST(count(*) AS DOUBLE), 6) AS pct_unforgettable,
               round(count(*) FILTER (never_learnt) * 100 / CAST(count(*) AS DOUBLE), 6) AS pct_never_learnt,
               round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score
        FROM ensemble""",
    ),
    "forgetting_histogram": (forgetting_histogram, HISTOGRAM_SQL),
    "forgetting_sorted": (
        forgetting_sorted,
        f"""WITH {ENSEMBLE_SQL}
        SELECT row_number() OVER (ORDER BY score, sample_id) - 1 AS position, sample_id, score,
               score = 0 AS unforgettable FROM ensemble""",
    ),
    "best_epoch": (
        lambda spark, folder: metrics.best_epoch(epoch_metrics(spark, folder)),
        f"""WITH {EPOCH_METRICS}, first AS (
          SELECT * FROM epoch_metrics WHERE val_acc IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) = 1)
        SELECT run, coalesce(val_acc, 'nan'::DOUBLE) AS best_val_acc,
               coalesce(val_loss, 'nan'::DOUBLE) AS best_val_loss
        FROM (SELECT DISTINCT run FROM epoch_metrics) LEFT JOIN first USING (run)""",
    ),
    "best_val_loss": (
        lambda spark, folder: metrics.best_val_loss(epoch_metrics(spark, folder)),
        f"""WITH {EPOCH_METRICS}
        SELECT run, coalesce(min(val_loss), 'nan'::DOUBLE) AS best_val_loss
        FROM epoch_metrics GROUP BY run""",
    ),
    "run_table": (
        lambda spark, folder: rounded(run_table(run_results(spark, folder))),
        f"""WITH {RUN_RESULTS} SELECT method, percent_removed, seed, round(best_val_acc, 6) AS best_val_acc,
          round(best_val_loss, 6) AS best_val_loss, round(test_acc, 6) AS test_acc
        FROM run_results ORDER BY percent_removed, seed""",
    ),
    "subset_manifest": (
        lambda spark, folder: subset_manifest(run_results(spark, folder)),
        f"""WITH {RUN_RESULTS} SELECT DISTINCT method, percent_removed,
          'method=' || method || '/percent_removed=' || percent_removed AS path FROM run_results""",
    ),
    "aggregate_curves": (
        lambda spark, folder: rounded(curves(spark, folder)),
        f"WITH {CURVES_SQL} SELECT {CURVE_COLUMNS} FROM curves",
    ),
    "cropped_curves": (
        lambda spark, folder: rounded(C.crop_curves(curves(spark, folder), CROP)),
        f"WITH {CURVES_SQL} SELECT {CURVE_COLUMNS} FROM curves WHERE percent_removed IN (0, 10, 20, 30)",
    ),
    "retention_bands": (
        lambda spark, folder: rounded(C.retention_bands(curves(spark, folder), METRIC)),
        f"""WITH {CURVES_SQL} SELECT method, percent_removed, round(retention * 100, 6) AS retained_pct,
          round(test_acc_mean, 6) AS value, round(test_acc_mean - coalesce(test_acc_std, 0), 6) AS lower,
          round(test_acc_mean + coalesce(test_acc_std, 0), 6) AS upper FROM curves""",
    ),
    "scaling_law_fit": (
        scaling_law_fit,
        f"""WITH {FITS_SQL} SELECT method, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c,
          round(r2, 4) AS r2, abs(b) >= 20 AS at_bound FROM fits""",
    ),
    "scaling_law_curve": (
        scaling_law_curve,
        f"""WITH {FITS_SQL}, xs AS (
          SELECT method, CAST(point AS INTEGER) AS point, low + (high - low) * point / 199 AS x
          FROM (SELECT method, min(retention) AS low, max(retention) AS high FROM curves GROUP BY method),
               (SELECT unnest(range(200)) AS point))
        SELECT method, point, round(x * 100, 5) AS retained_pct, round(a * pow(x, b) + c, 5) AS value
        FROM xs JOIN fits USING (method)""",
    ),
    "relative_performance": (
        lambda spark, folder: rounded(C.relative_performance(curves(spark, folder), METRIC)),
        f"""WITH {BASELINE_SQL} SELECT method, percent_removed, round(test_acc_mean /
          CASE WHEN coalesce(baseline, best) = 0 THEN 1e-8::DOUBLE ELSE coalesce(baseline, best) END * 100, 6)
          AS relative_pct FROM based""",
    ),
    "method_budget_matrix": (
        lambda spark, folder: rounded(C.method_budget_matrix(curves(spark, folder), METRIC, BUDGETS)),
        f"""WITH {CURVES_SQL} SELECT method, {', '.join(
            f"coalesce(round(max(test_acc_mean) FILTER (percent_removed = {p}), 6), 'nan'::DOUBLE) AS p{p:02d}"
            for p in BUDGETS)} FROM curves GROUP BY method""",
    ),
    "efficiency_points": (
        lambda spark, folder: rounded(C.efficiency_points(curves(spark, folder), METRIC)),
        f"""WITH {BASELINE_SQL} SELECT method, percent_removed, round((1 - retention) * 100, 6) AS data_saved_pct,
          round((1 - test_acc_mean / baseline) * 100, 6) AS drop_pct
        FROM based WHERE percent_removed <> 0 AND baseline <> 0""",
    ),
    "budget_analysis": (
        budget_analysis,
        f"""WITH {ANALYSIS_SQL} SELECT method, percent_removed, round(retention_pct, 6) AS retention_pct,
          round(baseline_value, 6) AS baseline_value, round(metric_value, 6) AS metric_value,
          relative_pct, drop_pct FROM analysis""",
    ),
    "budget_analysis_loss": (
        budget_analysis_loss,
        f"""WITH {BASELINE_SQL} SELECT method, percent_removed, round(retention * 100, 6) AS retention_pct,
          round(loss_baseline, 6) AS baseline_value, round(val_loss_mean, 6) AS metric_value,
          round_even(loss_baseline / val_loss_mean * 100, 2) AS relative_pct,
          round_even((val_loss_mean / loss_baseline - 1) * 100, 2) AS drop_pct
        FROM based WHERE loss_baseline IS NOT NULL""",
    ),
    "safe_budget": (
        lambda spark, folder: rounded(C.safe_budgets(C.budget_analysis(curves(spark, folder), METRIC))),
        f"""WITH {ANALYSIS_SQL} SELECT method, percent_removed, round(retention_pct, 6) AS retention_pct,
          drop_pct FROM safe""",
    ),
    "best_method_per_budget": (
        lambda spark, folder: C.best_method_per_budget(curves(spark, folder), METRIC),
        f"WITH {ANALYSIS_SQL} SELECT percent_removed, method FROM best",
    ),
    "conclusion_lines": (conclusion_lines, CONCLUSIONS_SQL),
}
