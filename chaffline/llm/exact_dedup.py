"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its digests, each with the best document that carries it. In each
round `2 ** ROUND_BITS` neighbouring runs (a binomial step of that many bits of the run number)
become one: entries of equal digests merge, the better document stays. The sorted merge is Spark's
sort aggregate, which walks rows sorted by (run, digest). A run of a later round is spread
over as many tasks as its parts were, by its digests, so no task ever holds a whole run. On the
way back every entry asks the run it was merged into for the winner; an entry has at most
`2 ** ROUND_BITS` askers, so a text that fills a third of the table is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffline.session import cut_lineage

#: Runs that become one in a round, as a power of two.
ROUND_BITS = 4
#: The white space that does not count, and nothing else: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

# What must agree for two entries to be one: the digest, and two checks that are independent of it.
_SAME = ["digest", "check_bytes", "check_hash"]


def without_spaces(text: Column) -> Column:
    """A text without its white space, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _best() -> list[Column]:
    """Most code points first, then the smallest id; the number of rows."""
    return [F.max("best").alias("best"), F.sum("n").alias("n")]


def exact_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space. Of equal texts the one with the most
    code points in the original, then the smallest doc_id, stays: keep_id. `kept` tells whether
    the row is that document.

    A null text is an empty one. Rows that repeat a doc_id with equal texts count as members of
    the group, and all of them are `kept` if that id stays. A null doc_id is kept as an id
    that loses against any other. Long texts only pass through the hash. An empty table gives no
    rows. Other columns are not read.
    """
    plain = without_spaces(F.col(text))
    rows = cut_lineage(
        documents.select(
            F.col(doc_id).alias("doc_id"),
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2(plain, 256)).alias("digest"),
            F.octet_length(plain).alias("check_bytes"),
            F.xxhash64(plain).alias("check_hash"),
            F.char_length(F.coalesce(text, F.lit(""))).alias("points"),
        )
    )
    last_run = rows.agg(F.max("run")).first()[0] or 0

    # max() of (points, -id) is the longest, then the smallest id; null ids come last.
    candidate = F.struct("points", (-F.col("doc_id")).alias("minus_id")).alias("best")
    levels = [
        cut_lineage(
            rows.select("run", *_SAME, candidate, F.lit(1).cast("long").alias("n"))
            .groupBy("run", *_SAME)
            .agg(*_best())
        )
    ]
    while last_run:
        last_run >>= ROUND_BITS
        merged = (
            levels[-1]
            .withColumn("run", F.shiftright("run", ROUND_BITS))
            .groupBy("run", *_SAME)
            .agg(*_best())
        )
        levels.append(cut_lineage(merged))

    known = levels[-1].select("run", *_SAME, "best", "n")
    for level in reversed(levels[:-1]):
        asks = level.select("run", *_SAME).withColumn("above", F.shiftright("run", ROUND_BITS))
        above = known.withColumnRenamed("run", "above")
        known = asks.join(above, ["above", *_SAME]).drop("above")
    answered = rows.join(known, ["run", *_SAME])
    keep = (-F.col("best.minus_id")).alias("keep_id")
    return answered.select(
        "doc_id",
        keep,
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(-F.col("best.minus_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
