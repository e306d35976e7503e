"""The registered queries of the operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.llm import (
    arrow_tokens, decontaminate, exact_dedup, hard_negatives, language_id, packing, quality_qda, repeats, simhash_trie,
    substrings, toxicity_chain, vector_codes, warc_zip,
)

#: Kinds of toxic documents, learnt from the labelled ones, then the label itself.
CATEGORIES = ["kind_1", "kind_2", "toxic"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def warc_in_zip(spark: SparkSession, folder: str) -> DataFrame:
    packages = warc_zip.write_packages(table(spark, folder, "pages"))
    page = lambda c: F.regexp_extract(c, r"page:(-?\d+)", 1).try_cast("long")
    return warc_zip.read_packages(packages).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to"))).alias("refers_to"),
    )


WARC_IN_ZIP = """
WITH keyed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
known AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response
  FROM keyed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM known"""


def exact_dedup_tree(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


EXACT_DEDUP_TREE = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
known AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM keyed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM known"""


def arrow_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = arrow_tokens.write_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return arrow_tokens.read_tokens(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


DECONTAMINATION = r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_starts AS (
  SELECT item_id, words, least(len(words), 10) AS size,
         unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS first
  FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[first:first + size - 1], ' ') AS phrase FROM item_starts),
sizes AS (SELECT DISTINCT size FROM windows),
doc_starts AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS first
  FROM plain, sizes WHERE len(words) >= size),
doc_windows AS (
  SELECT doc_id, size, first, array_to_string(words[first:first + size - 1], ' ') AS phrase FROM doc_starts),
matches AS (SELECT doc_id, size, first, item_id FROM doc_windows JOIN windows USING (size, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(first, first + size)) AS place FROM (SELECT DISTINCT doc_id, size, first FROM matches))
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM plain LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, folder, "documents"), shingle=4, budget=4)


def kneser_ney_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    learnt = documents.where(fold_of("doc_id", 5) != 0)
    model = language_id.fit_model(learnt.select("lang", "text"))
    limits = language_id.calibrate(language_id.identify(learnt.where("lang IS NOT NULL"), model))
    return language_id.identify(documents, model, limits, name_rejected=True).select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where(fold_of("doc_id", 3) != 1)
    scores = quality_qda.classify_quality(table(spark, folder, "documents"), labels)
    return scores.select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(fold_of("doc_id", 3) != 1).select("doc_id", "toxic")
    sample = toxicity_chain.sample_of(labels, documents, "toxic")
    labelled = toxicity_chain.with_kinds(documents.select("doc_id", "text").join(sample, "doc_id"), "toxic", 2)
    chain = toxicity_chain.fit(labelled, CATEGORIES, known_by=["toxic"])
    return toxicity_chain.score(documents, chain).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"),
        *[F.col(c).alias(f"{c}_score") for c in CATEGORIES], (F.col("toxic") >= chain.thresholds[-1]).alias("toxic"),
    )


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def vector_compression(spark: SparkSession, folder: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, folder, "embeddings"))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("vec_id", F.concat_ws("", digits).alias("code"), "error", "label_error", "codebooks_sha256")


def _vector_compression_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(sub) AS sub, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT vec_id, p, sub, e,
               CAST(list_sum(list_transform(range(1, len(sub) + 1), lambda i: (sub[i] - entry[i]) * (sub[i] - entry[i]))) AS BIGINT) AS d
        FROM cut JOIN b{r} USING (p))
  GROUP BY vec_id, p)"""
    move = """
b{s} AS MATERIALIZED (
  SELECT p, e, coalesce(moved, entry) AS entry
  FROM b{r} LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved
    FROM (SELECT p, best.e AS e, i, CAST(sum(sub[i]) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT p, best, sub, unnest(range(1, len(sub) + 1)) AS i FROM a{r}) GROUP BY p, best.e, i)
    GROUP BY p, e) USING (p, e))"""
    steps = [(assign.format(r=r), move.format(r=r, s=r + 1)) for r in range(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS sub
  FROM (SELECT vec_id, v, unnest(range({parts})) AS p FROM kept)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, sub AS entry
  FROM cut JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{",".join(s for pair in steps for s in pair)},
{assign.format(r=rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeated_spans(table(spark, folder, "documents"), size=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SUBSTRING_DEDUP = r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS first FROM plain WHERE len(words) >= 13),
windows AS (
  SELECT doc_id, first, array_to_string(words[first:first + 12], ' ') AS phrase FROM starts),
earlier AS (SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + 13)) AS place
  FROM windows JOIN earlier USING (phrase) WHERE doc_id > least),
lists AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM plain)
       ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM plain LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved))


HARD_NEGATIVES = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


QUERIES = {
    "op1_harmonic_packing": (harmonic_packing, None),
    "op2_warc_in_zip": (warc_in_zip, WARC_IN_ZIP),
    "op3_exact_dedup_tree": (exact_dedup_tree, EXACT_DEDUP_TREE),
    "op4_arrow_token_files": (arrow_token_files, None),
    "op5_decontamination": (decontamination, DECONTAMINATION),
    "op6_simhash_trie": (simhash_near_dedup, None),
    "op7_kneser_ney_language": (kneser_ney_language, None),
    "op8_quality_discriminant": (quality_discriminant, None),
    "op9_toxicity_chain": (toxicity, None),
    "op10_repeated_passages": (repeated_passages, None),
    "op11_orchard_vector_codes": (vector_compression, _vector_compression_sql()),
    "op12_suffix_automata": (substring_dedup, SUBSTRING_DEDUP),
    "op13_onebit_hard_negatives": (hard_negative_mining, HARD_NEGATIVES),
}
