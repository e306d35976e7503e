"""Each stage decides on rows: repeated ids, null ids and one id with two texts."""

import random

import pytest
import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice("river stone the and cloud under walks green seven letter open".split()) + str(rng.randrange(50)) for _ in range(n))


def after(spark, stage, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = stage(spark, frame, FOLDER)
    assert found.columns == frame.columns
    return sorted(map(tuple, found.collect()), key=str)


def test_exact_keeps_one_row_of_each_group(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (2, b), (None, a), (3, a + " ")]
    assert after(spark, P.exact, rows) == sorted([(3, a + " "), (1, b), (None, c)], key=str)


def test_near_keeps_one_row_of_each_group(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(2, a + " "), (1, a), (1, a), (1, b), (None, c), (None, c), (None, " " + a)]
    assert after(spark, P.near, rows) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_a_column_named_like_the_key_stays(spark):
    frame = spark.createDataFrame([(1, prose(1), "x"), (2, prose(1) + " ", "y")], "doc_id long, text string, __ROW string")
    for stage in (P.quality, P.exact, P.near, P.clean):
        assert stage(spark, frame, FOLDER).columns == ["doc_id", "text", "__ROW"]
    assert [tuple(r)[::2] for r in P.near(spark, frame, FOLDER).collect()] == [(1, "x")]


def test_clean_decides_on_rows(spark):
    item = next(r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    bad, good = prose(1) + " " + item, prose(2)
    assert after(spark, P.clean, [(1, bad), (1, good), (None, bad), (None, good)]) == sorted([(1, good), (None, good)], key=str)


@pytest.mark.parametrize("ids", [(1, 1), (None, None)])
def test_quality_decides_on_rows(spark, ids):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in P.quality(spark, documents, FOLDER).collect()}
    rows = [tuple(r) for r in documents.collect()]
    good, bad = next(t for i, t in rows if i in kept), next(t for i, t in rows if i not in kept)
    extra = [(ids[0] and -1, good), (ids[1] and -1, bad)]
    found = after(spark, P.quality, rows + extra)
    assert [r for r in found if r[0] == extra[0][0]] == [extra[0]]
