"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, as a Parquet table, and decides on it alone: documents
that look bad go, then exact copies, near copies and documents with benchmark text; what is left is
packed. All stages but the last return the columns of documents.

Every stage decides on rows, not on ids: each row of its input gets a key of its own, written with
the input. So repeated rows leave one, rows without a doc_id are filtered like others, and two texts
under one id do not share their fate. A null text is the empty text; long texts are read whole;
columns besides doc_id and text are passed on as they are, whatever their names; an empty table
gives an empty table. Ties of equal ids go to the row that comes first in the written input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffline.llm import decontaminate, exact_dedup, packing, quality_qda, simhash_trie
from chaffline.llm.store import new_folder
from chaffline.session import cut_lineage


#: The key of a row within a stage; underscores are added while a column of the table has the name.
ROW = "__row"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key for each row, written so that it stays the row's own; the key's name."""
    row = ROW
    while row.lower() in {name.lower() for name in docs.columns}:
        row += "_"
    return cut_lineage(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The documents whose key is not among `gone` (column "row"), without the key."""
    return keyed.join(gone.withColumnRenamed("row", row), row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to their labels, scores one half or more.

    An empty text is scored like any other. Without labels of both kinds the classifier's own
    rule for such fits holds.
    """
    keyed, row = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    labels = labels.join(keyed.select("doc_id", row), "doc_id").select(row, "quality")
    scores = quality_qda.classify_quality(keyed, labels, doc_id=row)
    return _without(keyed, row, cut_lineage(scores.where("score < 0.5").select(F.col("doc_id").alias("row"))))


def _but_first(members: DataFrame, *order: Column) -> DataFrame:
    """Of rows (group, row, ...) the keys of all but the first of each group."""
    first = members.groupBy("group").agg(F.min_by("row", F.struct(*order, "row")).alias("first"))
    return cut_lineage(members.join(first, "group").where(F.col("row") != F.col("first")).select("row"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, white space aside, one: the longest, then that of the smallest id.

    Null and empty texts equal each other; a row without an id comes after those with one.
    """
    keyed, row = _keyed(docs)
    found = exact_dedup.exact_duplicates(keyed, doc_id=row).where("group_size > 1")
    about = keyed.select(
        F.col(row).alias("row"), "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points")
    )
    members = found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")).join(about, "row")
    return _without(keyed, row, _but_first(members, -F.col("points"), F.col("doc_id").isNull(), F.col("doc_id")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id.

    Near copies are rows whose SimHashes over four-word shingles differ in at most four bits; links
    reach on. Rows without words have fingerprint zero and link like others.
    """
    keyed, row = _keyed(docs)
    found = cut_lineage(simhash_trie.near_duplicates(keyed, shingle=4, budget=4, doc_id=row))
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = (
        found.join(groups, "component_id")
        .select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
        .join(keyed.select(F.col(row).alias("row"), "doc_id"), "row")
    )
    return _without(keyed, row, _but_first(members, F.col("doc_id").isNull(), F.col("doc_id")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; texts without words are clean."""
    keyed, row = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(keyed, benchmark, doc_id=row)
    return _without(keyed, row, cut_lineage(found.where("n_hit > 0").select(F.col("doc_id").alias("row"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, placed in sequences of 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", clean), ("pack", packed)]

#: Neither the classifier nor fingerprints or tokens can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
