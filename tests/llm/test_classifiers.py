import numpy as np
import pytest
from pyspark.sql import functions as F

from chaffline.llm import quality_qda, queries, toxicity_chain

FOLDER = "/root/testdata/sf0.1"


def rates(rows, label, predicted):
    """Shares found among the positive and the negative rows."""
    yes = [r[predicted] for r in rows if r[label] == 1]
    no = [r[predicted] for r in rows if r[label] == 0]
    return sum(map(bool, yes)) / len(yes), sum(map(bool, no)) / len(no)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.quality_discriminant(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    good, bad = rates(rows, "quality", "predicted")
    assert len(rows) > 1000 and good > 0.98 and bad < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_odd_documents(spark, odd_documents, odd_rows, no_documents):
    labels = [(d, i % 2) for i, (d, _) in enumerate(odd_rows)] + [(None, 1), (1, None), (13, 0), (13, 1), (10**9, 1)]
    frame = spark.createDataFrame([(*x, "in the way") for x in labels], "doc_id long, quality int, statistics string")
    for own in (frame, frame.where("quality = 1"), frame.limit(0)):
        scores = quality_qda.classify_quality(odd_documents, own).collect()
        assert len(scores) == len(odd_rows) and all(0 <= r.score <= 1 for r in scores)
    assert quality_qda.classify_quality(no_documents, frame).collect() == []


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(1)
    width = len(quality_qda.STATISTICS)
    rows = np.concatenate((rng.normal(0, 1, (300, width)), rng.normal(1, 2, (100, width))))
    labels = np.repeat([0, 1], [300, 100])
    sums = [np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for x in (rows[:300], rows[300:])]
    model = _fit_from(sums)
    z = (rows - rows.mean(0)) / rows.std(0)
    shared = sum(np.cov(z[labels == k].T, bias=True) * (labels == k).mean() for k in (0, 1))
    logs = []
    for k in (0, 1):
        own = 0.9 * np.cov(z[labels == k].T, bias=True) + 0.1 * shared
        own = 0.98 * own + 0.02 * np.trace(own) / width * np.eye(width)
        off = z - z[labels == k].mean(0)
        density = -0.5 * (off @ np.linalg.inv(own) * off).sum(1) - 0.5 * np.linalg.slogdet(own)[1]
        logs.append(density + np.log(((labels == k).sum() + 1) / 402))
    assert model.scores(rows) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def _fit_from(sums):
    return quality_qda.discriminant(np.array(sums))


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").withColumnRenamed("toxic", "label")
    rows = queries.toxicity(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    caught, false = rates(rows, "label", "toxic")
    # Some documents that are labelled toxic are junk here, without a toxic word in any language.
    assert len(rows) > 1000 and caught > 0.9 and false < 0.01


def test_toxicity_of_odd_documents(spark, odd_documents, odd_rows, no_documents):
    labelled = odd_documents.withColumn("one", (F.col("doc_id") % 2).cast("int")).withColumn("two", F.lit(0))
    for own in (labelled, labelled.where("one = 1"), labelled.limit(0)):
        chain = toxicity_chain.fit(own, ["one", "two"])
        rows = toxicity_chain.score(odd_documents, chain).collect()
        assert len(rows) == len(odd_rows) and all(0 < r.one < 1 and 0 < r.two < 1 for r in rows)
    assert toxicity_chain.score(no_documents, chain).collect() == []


def test_later_models_use_earlier_probabilities(spark):
    """The second label is the first one's: with words that say nothing else the chain passes it on."""
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2, 600)
    rows, columns = np.arange(600), first  # word 0 or word 1
    labels = np.stack((first, first), 1).astype(float)
    chain = toxicity_chain.fit_chain(spark, rows, columns, ["a", "b"], labels, np.arange(600) % 3, ["x", "y"])
    assert chain.models[1].before[0] > 0.05
    found = chain.probabilities(np.array([0, 1]), np.array([0, 1]), 3)
    assert found[0].max() < 0.1 and found[1].min() > 0.9


def test_a_fit_is_the_optimum():
    """Against Newton steps on the dense matrix of the same words."""
    rng = np.random.default_rng(4)
    matrix = (rng.random((200, 12)) < 0.3).astype(float)
    before = rng.normal(size=(200, 2))
    labels = (rng.random(200) < 1 / (1 + np.exp(-(matrix @ rng.normal(size=12) + before[:, 0])))).astype(float)
    rows, columns = np.nonzero(matrix)
    model = toxicity_chain.fit_linear(rows, columns, 12, before, labels, penalty=1e-2)
    full = np.concatenate((matrix, before, np.ones((200, 1))), 1)
    penalty = np.diag([1e-2] * 14 + [0.0])
    point = np.zeros(15)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ point))
        slope = full.T @ (p - labels) / 200 + penalty @ point
        point -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / 200 + penalty, slope)
    found = np.concatenate((model.words, model.before, [model.bias]))
    assert found == pytest.approx(point, abs=1e-3)


def test_kinds_share_words():
    groups = [["idle", "vain"], ["loud", "rude"]]
    words = [groups[i % 2][j] for i in range(40) for j in range(2)]
    names = sorted({w for g in groups for w in g})
    rows, columns = np.repeat(np.arange(40), 2), np.array([names.index(w) for w in words])
    found = toxicity_chain.kinds_of(rows, columns, 40, 4, 2)
    assert len(set(found[::2])) == 1 and len(set(found[1::2])) == 1 and found[0] != found[1]


def test_sample_is_bounded(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("x"))
    bad = spark.createDataFrame([(None, 1), (10**9, 1), (3, None), (4, 7)], "doc_id long, x int")
    sample = toxicity_chain.sample_of(labels.union(bad), documents, "x", 50)
    assert sample.count() == 50 and sample.where("doc_id = 1000000000 OR x NOT IN (0, 1)").count() == 0
