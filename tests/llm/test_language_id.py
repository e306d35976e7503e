import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from chaffline.llm import language_id, queries

FOLDER = "/root/testdata/sf0.01"


def brute_model(texts, order):
    """log P of the last character of a gram, straight from the definition."""
    counts = {order: Counter()}
    for text in texts:
        text = "\2" * (order - 1) + text
        counts[order].update(text[i : i + order] for i in range(len(text) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        once, twice = (sum(1 for v in c.values() if v == i) for i in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def probability(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        n = len(gram)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return probability(gram[1:])
        total = sum(own.values())
        weight = discount[n] * len(own) / total
        return max(own.get(gram, 0) - discount[n], 0) / total + weight * probability(gram[1:])

    return probability


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_probabilities(spark, order):
    texts = {"x": ["abracadabra", "abc abd", "cab"], "y": ["zzyzx", "xyz xyzzy"]}
    rows = [(lang, t) for lang, own in texts.items() for t in own]
    model = language_id.fit_model(spark.createDataFrame(rows, "lang string, text string"), order)
    grams = ["abra"[:order], "\2\2\2a"[-order:], "bcab"[:order], "qqqq"[:order], "yzzy"[-order:], "zabq"[-order:]]
    found = model.log_probabilities(grams)
    for i, lang in enumerate(model.languages):
        truth = brute_model(texts[lang], order)
        assert found[:, i].tolist() == pytest.approx([math.log(truth(g)) for g in grams], rel=1e-4)


@pytest.mark.parametrize("most", [language_id.MODEL_ROWS, 0])
def test_language_and_score_by_brute_force(spark, monkeypatch, most):
    """The chosen language, its score and the cross-entropy, with the model in tasks and as a table."""
    monkeypatch.setattr(language_id, "MODEL_ROWS", most)
    texts = {"x": ["abracadabra", "abc abd", "cab"], "y": ["zzyzx", "xyz xyzzy"], "z": ["axa bxb", "zab"]}
    rows = [(lang, t) for lang, own in texts.items() for t in own]
    model = language_id.fit_model(spark.createDataFrame(rows, "lang string, text string"))
    assert isinstance(model, language_id.Model if most else language_id.ModelTable)
    truth = {lang: brute_model(own, 3) for lang, own in texts.items()}
    asked = ["abra cab", "zyx", "xaxaxa zabra", "q", "a", None, " 12 ", "ZYZZY!", "ab" * 200, "日本"]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    for i, text in enumerate(asked):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, False)
            continue
        codes, _ = language_id.folded([text], 3)
        plain = "".join(map(chr, codes))
        grams = [plain[j - 2 : j + 1] for j in range(3, len(plain))]
        entropy = {lang: -sum(math.log(p(g)) for g in grams) / len(grams) for lang, p in truth.items()}
        best = min(sorted(entropy), key=entropy.get)
        score = 1 / sum(math.exp(-(e - entropy[best]) * min(len(grams), 64)) for e in entropy.values())
        assert got[i].lang_pred == best and got[i].chars == len(grams)
        assert (got[i].score, got[i].cross_entropy) == (pytest.approx(score, rel=1e-3), pytest.approx(entropy[best], rel=1e-4))


def test_ten_million_grams_hide_no_unseen_one():
    """However many grams a language has, one that it has not is unknown."""
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(-(2**63), 2**63 - 1, 10_000_000))
    one = np.zeros(1, np.float32)
    model = language_id.Model(["x"], 1, [[np.zeros(1, np.int64), hashes]], [[one, np.zeros(len(hashes), np.float32)]], [[one, one]])
    unseen = rng.integers(-(2**63), 2**63 - 1, 100_000)
    assert np.isnan(model._find(0, 1, unseen[~np.isin(unseen, hashes)])[0]).all()


def test_the_query_tells_what_it_rejects(spark):
    rows = queries.kneser_ney_language(spark, FOLDER).collect()
    assert 0 <= sum(r.rejected for r in rows) < 0.05 * len(rows)
    assert all(r.lang_pred != "und" for r in rows if r.rejected)


def test_probabilities_sum_to_one(spark):
    model = language_id.fit_model(spark.createDataFrame([("x", "abcabcabd"), ("x", "bad cab")], "lang string, text string"))
    for context in ("ab", "ca", "qq", "\2\2"):
        every = model.log_probabilities([context + c for c in "abcd ?"])[:, 0]
        assert sum(map(math.exp, every)) == pytest.approx(1, rel=1e-4)


def test_folding():
    codes, owner = language_id.folded(["Ab  1,c", "", "É"], 2)
    assert codes.tolist() == [2, 2, *map(ord, "ab c"), 2, 2, 2, 2, ord("é")]
    assert owner.tolist() == [0] * 6 + [1] * 2 + [2] * 3


def test_grams_dense_and_sparse_agree(monkeypatch):
    codes, owner = language_id.folded(["some text of letters", "ünd ander", ""], 3)
    one = language_id.grams(codes, owner, 3)
    monkeypatch.setattr(language_id, "DENSE_CODES", 0)
    two = language_id.grams(codes, owner, 3)
    assert all((a == b).all() for a, b in zip(one, two))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = queries.kneser_ney_language(spark, FOLDER).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(spark, odd_documents, odd_rows):
    training = spark.createDataFrame([("x", "the on ner foo"), ("y", "日本語"), (None, "abc"), ("z", None), ("z", "")], "lang string, text string")
    model = language_id.fit_model(training)
    rows = language_id.identify(odd_documents, model).collect()
    assert len(rows) == len(odd_rows)
    lettered = {d: any(c.isalpha() for c in t or "") for d, t in odd_rows}
    assert {r.doc_id: r.lang_pred != "und" for r in rows if r.doc_id} == {d: v for d, v in lettered.items() if d}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_without_training_texts(spark, odd_documents, no_documents):
    empty = language_id.fit_model(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language_id.identify(odd_documents, empty).collect()} == {"und"}
    assert language_id.identify(no_documents, empty).collect() == []


def test_rejection_is_calibrated(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit_model(documents)
    limits = language_id.calibrate(language_id.identify(documents, model))
    assert set(limits) == set(model.languages)
    strange = spark.createDataFrame([(1, "xq zv kjw pqx vvz qqj " * 20)], "doc_id long, text string")
    assert language_id.identify(strange, model, limits).first().rejected
    own = language_id.identify(documents, model, limits).groupBy("rejected").count().collect()
    counts = defaultdict(int, {r.rejected: r["count"] for r in own})
    assert counts[True] < 0.02 * counts[False]
