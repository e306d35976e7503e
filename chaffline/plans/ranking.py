"""Queries over labelled samples: ranks, splits, subsets, picks, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaffline.operators import splits, subsets
from chaffline.operators.positions import with_rank
from chaffline.plans.views import BUDGETS, LABELLED_IDS, SAMPLES, labelled_ids, sample_labels, table, texts
from chaffline.scorers.base import rank_together, score_summary
from chaffline.scorers.registry import get_scorer
from chaffline.sources.artifacts import ranking_metadata

SPLIT_SEED = 42
GRID = str(BUDGETS)

QUALITY_SQL = r"""sized AS (
  SELECT sample_id, label, text, length(text) AS chars, greatest(length(text), 1) AS size,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS alpha,
    length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS alnum,
    length(regexp_replace(text, '[^\p{Z}\x09-\x0D\x1C-\x1F\x{85}]+', '', 'g')) AS spaces,
    CASE WHEN length(text) > 0 THEN len(list_distinct(string_split(text, ''))) ELSE 0 END AS kinds
  FROM samples),
quality AS (
  SELECT sample_id, label,
    CAST(CAST(alpha / CAST(size AS DOUBLE) * 0.4::DOUBLE + kinds / CAST(size AS DOUBLE) * 0.3::DOUBLE
      + (1.0::DOUBLE - spaces / CAST(size AS DOUBLE)) * 0.15::DOUBLE
      + (1.0::DOUBLE - (chars - alnum - spaces) / CAST(size AS DOUBLE)) * 0.15::DOUBLE AS FLOAT) AS DOUBLE)
      AS score
  FROM sized),
heuristic AS (
  SELECT sample_id, label, score, row_number() OVER (ORDER BY score, sample_id) - 1 AS rank,
         'heuristic_filtering' AS method
  FROM quality)"""
HEURISTIC_SQL = f"{SAMPLES}, {QUALITY_SQL}"
RANDOM_SQL = """shuffled AS (
  SELECT sample_id, label,
         row_number() OVER (ORDER BY md5(concat_ws('|', '777', sample_id)), sample_id) - 1 AS rank,
         count(*) OVER () AS n
  FROM samples),
random_ranking AS (
  SELECT sample_id, label,
         CAST(CAST(rank / CAST(greatest(n - 1, 1) AS DOUBLE) AS {kind}) AS DOUBLE) AS score, rank,
         'random' AS method
  FROM shuffled)"""
BOTH_SQL = (
    f"{HEURISTIC_SQL}, {RANDOM_SQL.format(kind='DOUBLE')}, "
    "rankings AS (SELECT * FROM heuristic UNION ALL SELECT * FROM random_ranking)"
)


def stable_scores(spark, folder):
    """Text lengths folded to 0..99: whole numbers with many ties."""
    return texts(spark, folder).select(
        "sample_id", (F.length("text") % 100).cast("double").alias("score")
    )


def stable_sql(base):
    return f"""WITH {SAMPLES}, s AS (
      SELECT sample_id, CAST(length(text) % 100 AS DOUBLE) AS score FROM samples)
    SELECT sample_id, score, row_number() OVER (ORDER BY score, sample_id) - 1 + {base} AS rank FROM s"""


def heuristic_ranking(spark, folder):
    return get_scorer("heuristic_filtering").score(
        texts(spark, folder), sample_labels(spark, folder)
    )


def random_ranking(spark, folder):
    return get_scorer("random", seed=777).score(sample_labels(spark, folder))


def all_scores(spark, folder):
    labels = sample_labels(spark, folder)
    return [
        get_scorer("heuristic_filtering").scores(texts(spark, folder), labels),
        get_scorer("random", seed=777).scores(labels),
    ]


def all_rankings(spark, folder):
    """Both methods ranked in one pass of the position helper."""
    return rank_together(all_scores(spark, folder))


def random_split(spark, folder):
    return splits.random_split(sample_labels(spark, folder), 0.1, SPLIT_SEED)


def stratified_split(spark, folder):
    labels = sample_labels(spark, folder)
    return splits.stratified_split(labels, int(labels.count() * 0.2), SPLIT_SEED)


def percentile_grid(spark, folder):
    """The budgets with the number of samples each removes from the corpus."""
    n = table(spark, folder, "documents").agg(F.count(F.lit(1))).scalar()
    return subsets.percentile_grid(spark, 0, 90, 10).select(
        "percent_removed", F.call_function("div", n * F.col("percent_removed"), F.lit(100)).alias("removes")
    )


def subset_query(direction):
    def query(spark, folder):
        return subsets.build_subsets(heuristic_ranking(spark, folder), BUDGETS, direction)

    place = "rank" if direction == subsets.REMOVE_EASY else "n - 1 - rank"
    sql = f"""WITH {HEURISTIC_SQL}, placed AS (
      SELECT method, sample_id, {place} AS place, n, unnest({GRID}) AS percent_removed
      FROM heuristic, (SELECT count(*) AS n FROM samples))
    SELECT method, percent_removed, sample_id, place - n * percent_removed // 100 AS position
    FROM placed WHERE place >= n * percent_removed // 100"""
    return query, sql


def subset_audit(spark, folder):
    audit = subsets.audit_subsets(heuristic_ranking(spark, folder), [0, *BUDGETS[1:], 100])
    return audit.withColumns(
        {c: F.round(c, 6) for c in ("retained_mean_score", "removed_mean_score")}
    )


def retained_rows(spark, folder):
    return subsets.retained_rows(sample_labels(spark, folder), labelled_ids(spark, folder))


def removed_rows(spark, folder):
    return subsets.removed_rows(sample_labels(spark, folder), labelled_ids(spark, folder))


def _heuristic_scores(spark, folder):
    return get_scorer("heuristic_filtering").scores(
        texts(spark, folder), sample_labels(spark, folder)
    )


def easy_hard_random(spark, folder):
    return subsets.easy_hard_random(_heuristic_scores(spark, folder), 1000, SPLIT_SEED)


PICKS_SQL = f"""{HEURISTIC_SQL},
size AS (SELECT least(1000, count(*) // 4) AS pick FROM samples),
orders_ AS (
  SELECT sample_id, score, row_number() OVER (ORDER BY score, sample_id) AS easy,
         row_number() OVER (ORDER BY score DESC, sample_id DESC) AS hard,
         row_number() OVER (ORDER BY md5(concat_ws('|', '{SPLIT_SEED}', sample_id)), sample_id) AS random
  FROM quality),
picks AS (
  SELECT category, sample_id, score FROM (
    SELECT 'easy' AS category, easy AS place, * FROM orders_
    UNION ALL SELECT 'hard', hard, * FROM orders_
    UNION ALL SELECT 'random', random, * FROM orders_), size
  WHERE place <= pick)"""


def picked_samples(spark, folder):
    picks = easy_hard_random(spark, folder)
    return subsets.picked_samples(sample_labels(spark, folder), picks)


def attach_scores(spark, folder):
    """Scores are known for the labelled documents only."""
    scores = _heuristic_scores(spark, folder)
    known = subsets.retained_rows(scores, labelled_ids(spark, folder))
    return subsets.attach_scores(sample_labels(spark, folder), known)


def preferred_ranking(spark, folder):
    return subsets.preferred_ranking(all_rankings(spark, folder))


#: Lists of methods, some of them not among the preferred ones and one without a ranking.
CONFIGURATIONS = {
    "own first": ["own_b", "own_a"],
    "preferred first": ["own_a", "random"],
    "missing": ["perplexity_filtering", "own_a"],
}


def preferred_of_configured(spark, folder):
    """The choice under several lists, over rankings of own and of preferred methods."""
    both = all_rankings(spark, folder)
    heuristic, random = (both.filter(F.col("method") == m) for m in ("heuristic_filtering", "random"))
    named = (
        heuristic.withColumn("method", F.lit("own_b"))
        .unionByName(random.withColumn("method", F.lit("own_a")))
        .unionByName(random)
    )
    chosen = [
        subsets.preferred_ranking(named, methods).withColumn("configuration", F.lit(name))
        for name, methods in CONFIGURATIONS.items()
    ]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).select(
        "configuration", "method", "sample_id", "label", "score", "rank"
    )


def rank_summary(spark, folder):
    """The scores suffice, no rank is needed."""
    heuristic, random = all_scores(spark, folder)
    summary = score_summary(heuristic.unionByName(random))
    return summary.withColumn("mean_score", F.round("mean_score", 6))


def metadata(spark, folder):
    heuristic, random = all_scores(spark, folder)
    return ranking_metadata(heuristic.unionByName(random), "documents", {"random_seed": 777})


RANK_RANDOM_SQL = f"WITH {SAMPLES}, {RANDOM_SQL.format(kind='DOUBLE')} SELECT * FROM random_ranking"

STRATIFIED_SQL = f"""WITH {SAMPLES},
placed AS (
  SELECT sample_id, label, row_number() OVER (
           PARTITION BY label ORDER BY md5(concat_ws('|', '{SPLIT_SEED}', sample_id)), sample_id) - 1 AS p,
         count(*) OVER (PARTITION BY label) AS n_class, count(*) OVER () AS n
  FROM samples),
quotas AS (
  SELECT *, CAST(greatest(1, least(round_even(n_class * floor(n * 0.2::DOUBLE) / n, 0), n_class - 1))
              AS BIGINT) AS quota, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS val_size
  FROM placed),
listed AS (
  SELECT *, p < quota AS in_val,
         row_number() OVER (PARTITION BY p < quota ORDER BY label, p) - 1 AS place,
         count(*) FILTER (p < quota) OVER () AS chosen
  FROM quotas)
SELECT sample_id, CASE WHEN in_val AND place < val_size THEN 'val'
                       WHEN NOT in_val AND place >= n - chosen - greatest(val_size - chosen, 0) THEN 'val'
                       ELSE 'train' END AS split
FROM listed"""

QUERIES = {
    "stable_rank": (
        lambda spark, folder: with_rank(stable_scores(spark, folder)),
        stable_sql(0),
    ),
    "stable_rank_one_based": (
        lambda spark, folder: with_rank(stable_scores(spark, folder), base=1),
        stable_sql(1),
    ),
    "rank_random": (random_ranking, RANK_RANDOM_SQL),
    "rank_heuristic": (heuristic_ranking, f"WITH {HEURISTIC_SQL} SELECT * FROM heuristic"),
    "rank_all_methods": (all_rankings, f"WITH {BOTH_SQL} SELECT * FROM rankings"),
    "score_summary": (
        rank_summary,
        f"""WITH {BOTH_SQL} SELECT method, count(*) AS n_samples, round(avg(score), 6) AS mean_score,
            min(score) AS min_score, max(score) AS max_score FROM rankings GROUP BY method""",
    ),
    "ranking_metadata": (
        metadata,
        f"""WITH {BOTH_SQL} SELECT method, 'documents' AS dataset, count(*) AS num_samples,
            '{{"random_seed":777}}' AS config FROM rankings GROUP BY method""",
    ),
    "random_split": (
        random_split,
        f"""WITH {SAMPLES}, placed AS (
          SELECT sample_id, count(*) OVER () AS n, row_number() OVER (
            ORDER BY md5(concat_ws('|', '{SPLIT_SEED}', sample_id)), sample_id) - 1 AS p FROM samples)
        SELECT sample_id, CASE WHEN p < greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END
          AS split FROM placed""",
    ),
    "stratified_split": (stratified_split, STRATIFIED_SQL),
    "percentile_grid": (
        percentile_grid,
        """SELECT CAST(p AS INTEGER) AS percent_removed, n * p // 100 AS removes
        FROM (SELECT unnest(range(0, 91, 10)) AS p), (SELECT count(*) AS n FROM documents)""",
    ),
    "subset_remove_easy": subset_query(subsets.REMOVE_EASY),
    "subset_remove_hard": subset_query(subsets.REMOVE_HARD),
    "subset_audit": (
        subset_audit,
        f"""WITH {HEURISTIC_SQL}, placed AS (
          SELECT *, rank >= n * percent_removed // 100 AS kept FROM (
            SELECT method, score, rank, n, unnest([0, 10, 20, 30, 50, 70, 90, 100]) AS percent_removed
            FROM heuristic, (SELECT count(*) AS n FROM samples)))
        SELECT method, percent_removed, count(*) FILTER (kept) AS retained,
               count(*) FILTER (NOT kept) AS removed,
               round(avg(score) FILTER (kept), 6) AS retained_mean_score,
               round(avg(score) FILTER (NOT kept), 6) AS removed_mean_score
        FROM placed GROUP BY method, percent_removed""",
    ),
    "retained_rows": (
        retained_rows,
        f"""WITH {SAMPLES}, {LABELLED_IDS}
        SELECT sample_id, label FROM samples SEMI JOIN labelled USING (sample_id)""",
    ),
    "removed_rows": (
        removed_rows,
        f"""WITH {SAMPLES}, {LABELLED_IDS}
        SELECT sample_id, label FROM samples ANTI JOIN labelled USING (sample_id)""",
    ),
    "easy_hard_random": (easy_hard_random, f"WITH {PICKS_SQL} SELECT * FROM picks"),
    "picked_samples": (
        picked_samples,
        f"WITH {PICKS_SQL} SELECT sample_id, label FROM samples SEMI JOIN picks USING (sample_id)",
    ),
    "attach_scores": (
        attach_scores,
        f"""WITH {HEURISTIC_SQL}, {LABELLED_IDS},
        known AS (SELECT sample_id, score FROM quality SEMI JOIN labelled USING (sample_id))
        SELECT sample_id, label, coalesce(score, 0.0::DOUBLE) AS score
        FROM samples LEFT JOIN known USING (sample_id)""",
    ),
    "preferred_ranking": (preferred_ranking, f"WITH {BOTH_SQL} SELECT * FROM heuristic"),
    "preferred_of_configured": (
        preferred_of_configured,
        f"""WITH {BOTH_SQL},
        named AS (
          SELECT 'own_b' AS own, * FROM heuristic UNION ALL SELECT 'own_a', * FROM random_ranking
          UNION ALL SELECT 'random', * FROM random_ranking),
        priorities(configuration, own, place) AS (
          VALUES ('own first', 'own_b', 1), ('own first', 'own_a', 2),
                 ('preferred first', 'random', 1), ('preferred first', 'own_a', 2),
                 ('missing', 'own_a', 2)),
        best AS (
          SELECT configuration, min(place) AS place FROM priorities SEMI JOIN named USING (own)
          GROUP BY configuration)
        SELECT configuration, own AS method, sample_id, label, score, rank
        FROM best JOIN priorities USING (configuration, place) JOIN named USING (own)""",
    ),
}
