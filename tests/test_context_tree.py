import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from chaffline.operators.prep import chunk_texts
from chaffline.scorers import context_tree, model_outputs

FOLDER = "/root/testdata/sf0.01"


def brute(texts, vocabulary_size, depth, least):
    """Probabilities straight from the definition."""
    follow = {}
    for text in texts:
        for i, c in enumerate(text):
            for k in range(min(i, depth) + 1):
                follow.setdefault(text[i - k : i], Counter())[c] += 1

    def chance(context, c):
        below = chance(context[1:], c) if context else 1 / (vocabulary_size + 1)
        own = follow.get(context)
        if own is None or (context and sum(own.values()) < least):
            return below
        return (own[c] + len(own) * below) / (sum(own.values()) + len(own))

    return chance


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, chunk string").repartition(3)


@pytest.mark.parametrize(("depth", "least", "rows"), [(3, 2, 10**6), (1, 1, 10**6), (4, 1, 60)])
def test_losses_equal_brute_force(spark, monkeypatch, depth, least, rows):
    monkeypatch.setattr(context_tree, "MODEL_ROWS", rows)
    texts = ["abracadabra", "bra bra cad", "über 🙂🙂 abra", "a", "", None, "aaaaab"]
    plain = [t or "" for t in texts]
    model = context_tree.fit_tree(frame(spark, texts), 12, depth, least)
    while rows < 10**6:  # the tree that fits is that of a larger count
        least *= 2
        kinds = Counter(t[i - k : i] for t in plain for i in range(len(t)) for k in range(min(i, depth) + 1))
        grams = {t[i - k : i + 1] for t in plain for i in range(len(t)) for k in range(min(i, depth) + 1)}
        kept = {c for c, n in kinds.items() if n >= least or not c}
        if sum(g[:-1] in kept for g in grams) + len(kept) <= rows:
            break
    chance = brute(plain, 12, depth, least)
    asked = [*texts, "cab zab", "qqq", "raca🙂b"]
    got = {r.id: (r.loss, r.n) for r in context_tree.tree_losses(frame(spark, asked), model, ["id"], depth).collect()}
    expected = {}
    for i, t in enumerate(asked):
        if t and len(t) > 1:
            own = [-math.log(chance(t[max(0, j - depth) : j], t[j])) for j in range(1, len(t))]
            expected[i] = (pytest.approx(np.mean(own), rel=1e-9), len(own))
    assert got == expected


def test_chances_sum_to_one(spark):
    model = context_tree.fit_tree(frame(spark, ["abcabcabd", "dabba"]), 4, 3, 2)
    pairs = [("ab" + c) for c in "abcd"] + ["ab?"]
    rows = context_tree.tree_losses(frame(spark, pairs), model, ["id"], 3).collect()
    first = context_tree.tree_losses(frame(spark, ["ab"]), model, ["id"], 3).first().loss
    assert sum(math.exp(-(r.loss * 2 - first)) for r in rows) == pytest.approx(1, rel=1e-9)


def test_longer_context_beats_pairs_on_held_out_chunks(spark):
    chunks = chunk_texts(spark.read.parquet(f"{FOLDER}/documents.parquet"), 128)
    seen, held = chunks.where("doc_id % 5 <> 0").persist(), chunks.where("doc_id % 5 = 0").persist()
    size = seen.select(F.explode(F.split("chunk", ""))).distinct().count()
    model = context_tree.fit_tree(seen, size)
    row = context_tree.tree_losses(held, model, ["doc_id", "chunk_idx"]).agg(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).first()
    pairs = {(r.context, r.next): r.loss for r in model_outputs.fit_bigrams(seen, size).collect()}
    totals = {r.context: r.context_n for r in model_outputs.fit_bigrams(seen, size).collect()}
    losses = [
        pairs.get((a, b), math.log(totals.get(a, 0) + size))
        for r in held.select("chunk").collect() for a, b in zip(r.chunk, r.chunk[1:])
    ]
    assert math.exp(row[0]) < 0.8 * math.exp(np.mean(losses))


def many_letters():
    """Texts of more letters than a key has room for beside each other, with repeats, and of few."""
    wide = "".join(chr(0x4E00 + 7 * i % 1500) for i in range(3000))
    return ["abab \0ab", wide, "\0\0", wide[::-1], None, "ba🙂ab", "", "a", wide[5:40] * 2, "abab"]


@pytest.mark.parametrize(("depth", "at_once", "held"), [(5, 1 << 20, 1 << 21), (5, 4, 8), (2, 4, 3), (12, 4, 8), (70, 64, 8)])
def test_grams_of_many_letters_and_small_slices(spark, monkeypatch, depth, at_once, held):
    monkeypatch.setattr(context_tree, "CHARACTERS_AT_ONCE", at_once)
    monkeypatch.setattr(context_tree, "HELD", held)
    texts = [t[:200] if t and depth > 12 else t for t in many_letters()]
    expected = Counter(t[i : i + k] for t in texts if t for i in range(len(t)) for k in range(1, depth + 2) if i + k <= len(t))
    chunks = spark.createDataFrame([(t,) for t in texts], "chunk string").coalesce(1)
    assert {r.gram: r.n for r in context_tree.count_grams(chunks, depth).collect()} == expected


@pytest.mark.parametrize("at_once", [1 << 20, 4])
def test_losses_of_many_letters_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(context_tree, "CHARACTERS_AT_ONCE", at_once)
    texts = many_letters()
    model = context_tree.fit_tree(frame(spark, texts), 1600, 5, 2)
    chance = brute([t or "" for t in texts], 1600, 5, 2)
    asked = [*texts, "ab" + texts[1][7:30] + "Ω"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, chunk string").coalesce(1)
    got = {r.id: r.loss for r in context_tree.tree_losses(rows, model, ["id"], 5).collect()}
    assert got == {
        i: pytest.approx(np.mean([-math.log(chance(t[max(0, j - 5) : j], t[j])) for j in range(1, len(t))]), rel=1e-9)
        for i, t in enumerate(asked) if t and len(t) > 1
    }


def test_tasks_give_each_longest_gram_once_and_look_up_each_window_once(monkeypatch):
    """However many slices a task has: the work on grams that are met again does not grow with them."""
    monkeypatch.setattr(context_tree, "CHARACTERS_AT_ONCE", 10)
    texts, given = ["abcabc", "bcabca"] * 20, []

    class Chunks:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            given.extend(r for b in run(iter([pa.RecordBatch.from_pydict({"chunk": texts})])) for r in b.to_pylist())
            raise StopIteration

    with pytest.raises(StopIteration):
        context_tree.count_grams(Chunks(), 2)
    expected = Counter(t[i : i + 3] for t in texts for i in range(len(t)))
    assert sorted((r["longest"], r["n"]) for r in given) == sorted(expected.items())

    tree = context_tree.Tree(np.zeros(1, np.int64), np.full(1, np.nan), np.full(1, 0.5), 2, 0.1)
    asked = []
    look = context_tree.Tree.window_losses
    monkeypatch.setattr(context_tree.Tree, "window_losses", lambda *a: asked.append(len(a[1])) or look(*a))
    scored = context_tree._Scored(tree)
    for text in texts:
        scored.losses([text])
    assert sum(asked) == len({t[max(0, i - 2) : i + 1] for t in texts for i in range(len(t))})


def test_a_tree_of_millions_of_rows_is_not_cut(spark):
    """Before, contexts met once went from a tree of more than four million rows, and stayed in a smaller one."""
    letters = np.random.default_rng(0).integers(0x4E00, 0x4E00 + 1000, (50, 13_000)).astype(np.uint32)
    texts = [row.tobytes().decode("utf-32-le") for row in letters]
    grams = [len({t[i : i + k] for t in texts for i in range(len(t) - k + 1)}) for k in range(1, 7)]
    contexts = 1 + sum(len({t[i : i + k] for t in texts for i in range(len(t) - k)}) for k in range(1, 6))
    assert sum(grams) + contexts > 4_000_000
    model = context_tree.fit_tree(frame(spark, texts), 1000, 5, 1)
    row = model.agg(F.count(F.when(F.col("gram") != "", F.col("p"))), F.count("escape")).first()
    assert tuple(row) == (sum(grams), contexts)


def test_losses_by_a_model_of_many_files_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "FILE_ROWS", 7)
    texts = ["abracadabra", "bra bra cad", "über 🙂🙂 abra", "a", "", None, "aaaaab"]
    model = context_tree.fit_tree(frame(spark, texts), 12, 4, 1)
    asked = [t for t in [*texts, "cab zab", "qqq", "raca🙂b"] if t and len(t) > 1]
    got = {r.id: r.loss for r in context_tree.tree_losses(frame(spark, asked), model, ["id"], 4).collect()}
    chance = brute([t or "" for t in texts], 12, 4, 1)
    assert got == {
        i: pytest.approx(np.mean([-math.log(chance(t[max(0, j - 4) : j], t[j])) for j in range(1, len(t))]), rel=1e-9)
        for i, t in enumerate(asked)
    }


@pytest.mark.parametrize("mappable", [True, False])
def test_rows_of_files_are_found_as_they_were_fitted(spark, monkeypatch, mappable):
    monkeypatch.setattr(context_tree, "FILE_ROWS", 7)
    model = context_tree.fit_tree(frame(spark, ["abracadabra", "bra bra cad"]), 12, 3, 1)
    tree = context_tree.file_tree(model, 3)
    rows = model.collect()
    assert len(tree.files) > 3 and sum(f.rows for f in tree.files) == len(rows)
    if not mappable:
        locate = context_tree._locate
        monkeypatch.setattr(context_tree, "_locate", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), locate(uri)[1][1:]))
    asked = [r.gram for r in rows] + ["x", "xyz", "bq"]
    points = np.array([[ord(c) for c in t.ljust(4)] for t in asked], np.uint32)
    chances, escapes = tree._find(points, np.array([len(t) for t in asked]))
    none = float("nan")
    expected = [(none if r.p is None or not r.gram else r.p, none if r.escape is None else r.escape) for r in rows] + [(none, none)] * 3
    np.testing.assert_array_equal(np.stack([chances, escapes], axis=1), np.array(expected))
    assert tree.share == 1 / 13
