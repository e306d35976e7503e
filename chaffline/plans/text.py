"""Queries over documents: scans, vocabulary, chunks, features, text scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaffline.operators import prep
from chaffline.operators.subsets import retained_rows
from chaffline.operators.vocabulary import Codec, build_vocabulary, decode_without_vocabulary
from chaffline.plans.views import (
    BLOCK_SIZE,
    LABELLED_IDS,
    SAMPLES,
    documents,
    labelled_ids,
    sample_labels,
    texts,
)
from chaffline.scorers import context_tree, model_outputs
from chaffline.scorers.registry import get_scorer
from chaffline.sources import corpus

CHUNK = BLOCK_SIZE + 1

LETTERS_SQL = """letters AS (
  SELECT doc_id, generate_subscripts(chars, 1) AS pos, unnest(chars) AS ch
  FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, '') ELSE [] END AS chars
        FROM documents))"""
VOCABULARY_SQL = """vocabulary AS (
  SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS INTEGER) AS token_id
  FROM (SELECT DISTINCT ch FROM letters))"""
CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, substr(text, i * {CHUNK} + 1, {CHUNK}) AS chunk
  FROM (SELECT doc_id, text, unnest(range((length(text) + {BLOCK_SIZE}) // {CHUNK})) AS i FROM documents))"""
CHUNK_LETTERS_SQL = f"""chunk_letters AS (
  SELECT doc_id, CAST((pos - 1) // {CHUNK} AS INTEGER) AS chunk_idx, (pos - 1) % {CHUNK} AS place, ch
  FROM letters)"""
BIGRAMS_SQL = """pairs AS (
  SELECT a.doc_id, a.chunk_idx, a.place AS token_pos, a.ch AS context, b.ch AS next
  FROM chunk_letters a JOIN chunk_letters b
    ON b.doc_id = a.doc_id AND b.chunk_idx = a.chunk_idx AND b.place = a.place + 1),
pair_counts AS (SELECT context, next, count(*) AS n FROM pairs GROUP BY ALL),
contexts AS (SELECT context, sum(n) AS context_n FROM pair_counts GROUP BY ALL),
model AS (
  SELECT context, next, n, context_n,
         -ln((n + 1) / CAST(context_n + (SELECT count(*) FROM vocabulary) AS DOUBLE)) AS loss
  FROM pair_counts JOIN contexts USING (context)),
losses AS (SELECT doc_id, chunk_idx, token_pos, loss FROM pairs JOIN model USING (context, next))"""
NGRAM_SQL = ",\n".join([LETTERS_SQL, VOCABULARY_SQL, CHUNK_LETTERS_SQL, BIGRAMS_SQL])
NUMBERS_SQL = """numbers AS (
  SELECT doc_id, chunk_idx, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS sample_id
  FROM (SELECT DISTINCT doc_id, chunk_idx FROM chunk_letters))"""


def scan_documents(spark, folder):
    return corpus.documents(spark, f"{folder}/documents.parquet")


def samples_for_subset(spark, folder):
    """The text is read and kept for the chosen ids only; their labels join narrow rows."""
    chosen = labelled_ids(spark, folder)
    labels = retained_rows(sample_labels(spark, folder), chosen)
    return retained_rows(texts(spark, folder), chosen).join(labels, "sample_id").select(
        "sample_id", "label", "text"
    )


def char_vocab(spark, folder):
    return build_vocabulary(documents(spark, folder))


def joined(tokens):
    return F.array_join(F.col(tokens).cast("array<string>"), ",")


def encode_text(spark, folder):
    rows = documents(spark, folder)
    codec = Codec.fit(rows)
    return rows.select("doc_id", codec.encode(F.col("text")).alias("tokens")).select(
        "doc_id", joined("tokens").alias("tokens")
    )


def decode_tokens(spark, folder):
    rows = documents(spark, folder)
    codec = Codec.fit(rows)
    encoded = rows.select("doc_id", codec.encode(F.col("text")).alias("tokens"))
    return encoded.select(
        "doc_id",
        codec.decode(F.col("tokens")).alias("text"),
        decode_without_vocabulary(F.col("tokens")).alias("clamped"),
    )


def chunk_text(spark, folder):
    return prep.numbered_chunks(documents(spark, folder), BLOCK_SIZE)


def next_token_pairs(spark, folder):
    rows = documents(spark, folder)
    codec = Codec.fit(rows)
    encoded = prep.chunk_texts(rows, BLOCK_SIZE).select(
        "doc_id", "chunk_idx", codec.encode(F.col("chunk")).alias("tokens")
    )
    return prep.next_token_pairs(encoded).select(
        "doc_id", "chunk_idx", "label", joined("input").alias("input"), joined("target").alias("target")
    )


def text_features(spark, folder):
    """One row per bucket that is not empty."""
    features = prep.text_features(texts(spark, folder))
    return (
        features.select("sample_id", F.posexplode("features").alias("bucket", "value"))
        .filter("value <> 0")
        .select("sample_id", "bucket", F.round("value", 6).alias("value"))
    )


def _model(spark, folder, chunks=None):
    """(chunks, counted model, codec); one fit of the vocabulary serves both."""
    rows = documents(spark, folder)
    chunks = prep.chunk_texts(rows, BLOCK_SIZE) if chunks is None else chunks
    codec = Codec.fit(rows)
    return chunks, model_outputs.fit_bigrams(chunks, codec.size), codec


def context_tree_loss(spark, folder):
    """Mean loss per chunk under a context tree of the chunks of four documents in five; the fifth is unseen."""
    rows = documents(spark, folder)
    chunks = prep.chunk_texts(rows, BLOCK_SIZE)
    model = context_tree.fit_tree(chunks.where("doc_id % 5 <> 0"), Codec.fit(rows).size)
    return context_tree.tree_losses(chunks, model, ["doc_id", "chunk_idx"]).select(
        "doc_id", "chunk_idx", F.round("loss", 5).alias("loss"), "n"
    )


def ngram_token_loss(spark, folder):
    """Losses of all tokens, summed up per chunk for output."""
    chunks, model, _ = _model(spark, folder)
    scored = model_outputs.chunk_token_losses(chunks, model, ["doc_id", "chunk_idx"])
    above = F.filter(
        F.transform("losses", lambda x, i: F.when(x > 3, i.cast("long"))), lambda i: i.isNotNull()
    )
    return scored.where(F.size("losses") > 0).select(
        "doc_id",
        "chunk_idx",
        F.size("losses").cast("long").alias("n_tokens"),
        F.round(F.aggregate("losses", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total_loss"),
        F.round(F.array_min("losses"), 6).alias("min_loss"),
        F.round(F.array_max("losses"), 6).alias("max_loss"),
        F.when(
            F.size(above) > 0, F.aggregate(above, F.lit(0).cast("long"), lambda acc, i: acc + i)
        ).alias("places_above_3"),
    )


def rank_perplexity(spark, folder):
    """Scores chunks by the mean loss of their tokens, labelled by their first target token."""
    rows = documents(spark, folder)
    chunks, model, codec = _model(spark, folder)
    starts = prep.chunk_starts(rows, BLOCK_SIZE)
    means = model_outputs.chunk_losses(chunks, model, ["doc_id", "chunk_idx"])
    first = codec.token_of(F.col("first_target"))
    sample = (F.col("first_sample") + F.col("chunk_idx")).alias("sample_id")
    return get_scorer("perplexity_filtering").score(
        means.join(starts, "doc_id").select(sample, "loss", "n", first.cast("long").alias("label"))
    )


def context_entropy(spark, folder):
    """Entropy of the counted model's next-character distribution after every character."""
    _, model, codec = _model(spark, folder)
    return model_outputs.context_entropies(model, codec.size).select(
        "context", F.round("entropy", 6).alias("entropy")
    )


QUERIES = {
    "context_tree_loss": (context_tree_loss, None),
    "scan_documents": (scan_documents, "SELECT doc_id, text FROM documents"),
    "sample_labels": (sample_labels, f"WITH {SAMPLES} SELECT sample_id, label FROM samples"),
    "samples_for_subset": (
        samples_for_subset,
        f"WITH {SAMPLES}, {LABELLED_IDS} SELECT * FROM samples SEMI JOIN labelled USING (sample_id)",
    ),
    "char_vocab": (char_vocab, f"WITH {LETTERS_SQL}, {VOCABULARY_SQL} SELECT * FROM vocabulary"),
    "encode_text": (
        encode_text,
        f"""WITH {LETTERS_SQL}, {VOCABULARY_SQL}
        SELECT doc_id, coalesce(string_agg(token_id, ',' ORDER BY pos), '') AS tokens
        FROM documents LEFT JOIN (letters JOIN vocabulary USING (ch)) USING (doc_id)
        GROUP BY doc_id""",
    ),
    "decode_tokens": (
        decode_tokens,
        f"""WITH {LETTERS_SQL}, {VOCABULARY_SQL}
        SELECT doc_id, any_value(text) AS text,
          coalesce(string_agg(chr(greatest(32, least(126, token_id))), '' ORDER BY pos), '') AS clamped
        FROM documents LEFT JOIN (letters JOIN vocabulary USING (ch)) USING (doc_id)
        GROUP BY doc_id""",
    ),
    "chunk_text": (
        chunk_text,
        f"""WITH {CHUNKS_SQL}
        SELECT doc_id, chunk_idx, chunk,
               row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS sample_id FROM chunks""",
    ),
    "next_token_pairs": (
        next_token_pairs,
        f"""WITH {LETTERS_SQL}, {VOCABULARY_SQL}, {CHUNK_LETTERS_SQL},
        ids AS (SELECT * FROM chunk_letters JOIN vocabulary USING (ch))
        SELECT doc_id, chunk_idx, CAST(max(token_id) FILTER (place = 1) AS BIGINT) AS label,
               coalesce(string_agg(token_id, ',' ORDER BY place) FILTER (place < last), '') AS input,
               coalesce(string_agg(token_id, ',' ORDER BY place) FILTER (place > 0), '') AS target
        FROM (SELECT *, max(place) OVER (PARTITION BY doc_id, chunk_idx) AS last FROM ids)
        GROUP BY doc_id, chunk_idx""",
    ),
    "text_features": (
        text_features,
        """WITH grams AS (
          SELECT doc_id AS sample_id,
                 unnest(list_transform(range(1, length(text) - 1),
                        lambda i: chars[i] || chars[i + 1] || chars[i + 2])) AS gram
          FROM (SELECT doc_id, text, string_split(text, '') AS chars FROM documents)),
        counts AS (
          SELECT sample_id, CAST(('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
                 CAST(count(*) AS DOUBLE) AS n
          FROM grams GROUP BY ALL)
        SELECT sample_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY sample_id)), 6) AS value
        FROM counts""",
    ),
    "ngram_token_loss": (
        ngram_token_loss,
        f"""WITH {NGRAM_SQL}
        SELECT doc_id, chunk_idx, count(*) AS n_tokens, round(sum(loss), 6) AS total_loss,
               round(min(loss), 6) AS min_loss, round(max(loss), 6) AS max_loss,
               CAST(sum(token_pos) FILTER (loss > 3) AS BIGINT) AS places_above_3
        FROM losses GROUP BY ALL""",
    ),
    "rank_perplexity": (
        rank_perplexity,
        f"""WITH {NGRAM_SQL}, {NUMBERS_SQL},
        scores AS (
          SELECT sample_id, CAST(round(exp(avg(loss)), 6) AS FLOAT) AS score
          FROM losses JOIN numbers USING (doc_id, chunk_idx) GROUP BY sample_id),
        labels_ AS (
          SELECT sample_id, CAST(token_id AS BIGINT) AS label
          FROM chunk_letters JOIN vocabulary USING (ch) JOIN numbers USING (doc_id, chunk_idx)
          WHERE place = 1)
        SELECT sample_id, label, CAST(score AS DOUBLE) AS score,
               row_number() OVER (ORDER BY score, sample_id) - 1 AS rank,
               'perplexity_filtering' AS method
        FROM scores JOIN labels_ USING (sample_id)""",
    ),
    "context_entropy": (
        context_entropy,
        f"""WITH {NGRAM_SQL}, v AS (SELECT CAST(count(*) AS DOUBLE) AS size FROM vocabulary),
        shares AS (
          SELECT context, (n + 1) / (context_n + size) AS p, 1 / (context_n + size) AS q, size
          FROM model, v)
        SELECT context,
               round(sum(-p * ln(p + 1e-10::DOUBLE))
                     - (any_value(size) - count(*)) * any_value(q) * ln(any_value(q) + 1e-10::DOUBLE), 6)
                 AS entropy
        FROM shares GROUP BY context""",
    ),
}
