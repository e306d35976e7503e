import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_hits
from test_exact_dedup import brute as brute_groups
from test_packing import check
from test_simhash_trie import brute_components, brute_fingerprint

import corpus_pipeline as P
from chaffline.llm import quality_qda

FOLDER = "/root/testdata/sf0.01"


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, written out in between."""
    frame, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in P.STAGES:
        frame = stage(spark, frame, FOLDER).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, frame, FOLDER).persist()
        out.append(frame)
    return out


def test_stages_return_the_columns_of_documents(spark, stages):
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [name for name, _ in P.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    assert all(s.columns == names for s in stages[:-1])


def test_quality_rejects_bad_and_keeps_good_documents(spark, stages):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    known = documents.select("doc_id").join(labels, "doc_id")
    kept = known.join(stages[0].select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    rates = {r.quality: r.kept for r in kept.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.15
    statistics = quality_qda.document_statistics(documents)
    model = quality_qda.fit(statistics.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))
    rows = statistics.collect()
    scores = model.scores(np.array([r.statistics for r in rows]))
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r, s in zip(rows, scores) if s >= 0.5}


def test_exact_copies_go(stages):
    expected = {d for d, _, _, kept, _ in brute_groups(texts(stages[0])) if kept}
    assert {d for d, _ in texts(stages[1])} == expected


def test_near_copies_go(stages):
    rows = texts(stages[1])
    nodes = [(d, brute_fingerprint(t, 4)) for d, t in rows]
    expected = {d for (d, _), c in zip(nodes, brute_components(nodes, 4)) if c == d}
    assert {d for d, _ in texts(stages[2])} == expected
    assert len(expected) < len(rows)


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = texts(stages[2])
    expected = {d for d, _, hit, _ in brute_hits(rows, items, 10) if not hit}
    assert {d for d, _ in texts(stages[3])} == expected and len(expected) < len(rows)


def test_what_is_left_is_packed(spark, stages):
    from chaffline.llm import packing

    pieces = stages[4].collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert {p.doc_id for p in pieces} == {d for d, _ in texts(stages[3])}
    full = packing.pack(stages[3], P.public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert check(full, texts(stages[3]), 2048) < 0.01


def test_run_gives_the_pieces_of_the_stages(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows.select("doc_id", "doc_tokens").distinct().collect())
    assert key(P.run(spark, FOLDER)) == key(stages[4])


def test_odd_documents_pass_every_stage(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        for name, stage in P.STAGES:
            after = stage(spark, frame, FOLDER)
            if name != "pack":
                assert after.columns == frame.columns
                frame = after
            assert after.count() >= 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry module is complete without the operators' folder and the pipeline."""
    import os
    import shutil
    import subprocess

    root = Path(P.__file__).resolve().parent
    for name in ("chaffline", "__spark_entry__.py"):
        source = root / name
        copy = shutil.copytree if source.is_dir() else shutil.copy
        ignore = {"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}
        copy(source, tmp_path / name, **ignore)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n); assert set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
