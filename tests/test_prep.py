import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chaffline.functions.text import character_quality, characters
from chaffline.operators import prep, splits
from chaffline.operators.vocabulary import Codec, build_vocabulary, decode_without_vocabulary
from chaffline.scorers import model_outputs

ODD = ["", "a", "é́x", "😀b😀", "line\nbreak\ttab", "日本語 です"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_vocabulary_by_code_point(spark):
    rows = build_vocabulary(frame(spark, ODD)).orderBy("token_id").collect()
    assert [r.ch for r in rows] == sorted(set("".join(ODD)))
    assert [r.token_id for r in rows] == list(range(len(rows)))


def test_encode_and_decode_return_the_text(spark):
    rows = frame(spark, ODD)
    codec = Codec.fit(rows)
    found = rows.select("text", codec.encode(F.col("text")).alias("t")).select(
        "text", "t", codec.decode(F.col("t")).alias("back")
    )
    for r in found.collect():
        assert r.back == r.text and len(r.t) == len(r.text)


def test_unknown_characters(spark):
    codec = Codec("abc")
    rows = frame(spark, ["abz"])
    with pytest.raises(Exception, match="vocabulary"):
        rows.select(codec.encode(F.col("text"))).collect()
    ids = spark.createDataFrame([([0, 9, 2],)], "t array<int>")
    row = ids.select(
        codec.decode(F.col("t")).alias("blank"),
        codec.decode(F.col("t"), "?").alias("mark"),
        decode_without_vocabulary(F.array(F.lit(10), F.lit(65), F.lit(300))).alias("clamped"),
    ).first()
    assert (row.blank, row.mark, row.clamped) == ("ac", "a?c", " A~")


def test_chunks_keep_the_tail(spark):
    rows = frame(spark, ["abcdefg", "ab", "", "😀\n😀xyz"])
    expected = [(0, 0, "abc"), (0, 1, "def"), (0, 2, "g"), (1, 0, "ab"), (3, 0, "😀\n😀"), (3, 1, "xyz")]
    found = prep.chunk_texts(rows, 2).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, r.chunk) for r in found] == expected
    whole = prep.chunk_texts(rows, 2, whole_only=True).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, r.chunk) for r in whole] == [e for e in expected if len(e[2]) == 3]
    numbers = prep.numbered_chunks(rows, 2).orderBy("sample_id").collect()
    assert [(r.sample_id, r.doc_id, r.chunk_idx, r.chunk) for r in numbers] == [
        (i, *e) for i, e in enumerate(expected)
    ]


def test_numbering_moves_no_chunk(spark):
    rows = frame(spark, [f"{i} " * 30 for i in range(50)])
    whole = prep.numbered_chunks(rows, 4).orderBy("sample_id").collect()
    assert [r.sample_id for r in whole] == list(range(len(whole)))
    assert [r.doc_id for r in whole] == sorted(r.doc_id for r in whole)


def test_next_token_pairs(spark):
    rows = spark.createDataFrame([(1, [4, 5, 6])], "id long, tokens array<int>")
    row = prep.next_token_pairs(rows).first()
    assert (row.input, row.target, row.label) == ([4, 5], [5, 6], 5)
    one = spark.createDataFrame([(1, [4])], "id long, tokens array<int>")
    row = prep.next_token_pairs(one).first()
    assert (row.input, row.target, row.label) == ([], [], None)


def python_quality(text):
    n = max(len(text), 1)
    marks = sum(not c.isalnum() and not c.isspace() for c in text)
    return (
        sum(c.isalpha() for c in text) / n * 0.4
        + len(set(text)) / n * 0.3
        + (1 - sum(c.isspace() for c in text) / n) * 0.15
        + (1 - marks / n) * 0.15
    )


def test_character_quality(spark):
    texts = ODD + ["12 ½ Ⅷ", "a\x1cb\x85c d", "!?…", "x" * 1000]
    rows = frame(spark, texts).select("text", character_quality(F.col("text")).alias("q"))
    for r in rows.collect():
        assert r.q == pytest.approx(python_quality(r.text), abs=1e-12), repr(r.text)


def test_characters(spark):
    row = frame(spark, ["a😀\nbc"]).select(characters(F.col("text")).alias("c")).first()
    assert row.c == list("a😀\nbc")


def gram_counts(text):
    import hashlib

    counts = [0.0] * 64
    for i in range(len(text) - 2):
        digest = hashlib.md5(text[i : i + 3].encode()).hexdigest()
        counts[int(digest[:8], 16) % 64] += 1
    length = sum(c * c for c in counts) ** 0.5 or 1.0
    return [c / length for c in counts]


def test_text_features_equal_counting(spark):
    texts = [*ODD, "abc" * 50, "", "ab", "x😀y😀z"]
    rows = frame(spark, texts).withColumnRenamed("doc_id", "sample_id")
    found = {r.sample_id: r.features for r in prep.text_features(rows).collect()}
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(gram_counts(text)), repr(text)


def test_grams_of_slices_equal_grams_at_once(monkeypatch):
    from chaffline.functions import grams

    texts = ["hello world", "", "ab", "abcd", "ééé"]
    whole = grams.hashed_grams()(texts)
    monkeypatch.setattr(grams, "_CHARACTERS_AT_ONCE", 3)
    assert (grams.hashed_grams()(texts) == whole).all()
    assert grams.hashed_grams()([]).shape == (0, 64)
    assert grams.hashed_grams()(["", ""]).sum() == 0


def test_any_function_makes_features(spark):
    import numpy as np

    rows = frame(spark, ["a", "bcd"]).withColumnRenamed("doc_id", "sample_id")
    lengths = prep.text_features(rows, lambda texts: np.array([[len(t)] for t in texts]))
    assert {r.sample_id: r.features for r in lengths.collect()} == {0: [1.0], 1: [3.0]}


def test_text_features_unit_length_and_short_texts(spark):
    rows = frame(spark, ["", "ab", "abc", "hello world"]).withColumnRenamed("doc_id", "sample_id")
    found = {r.sample_id: r.features for r in prep.text_features(rows).collect()}
    assert all(len(v) == 64 for v in found.values())
    assert [round(sum(x * x for x in found[i]), 9) for i in range(4)] == [0, 0, 1, 1]


def test_random_split(spark):
    ids = spark.range(105).withColumnRenamed("id", "sample_id")
    first, again = (splits.random_split(ids, 0.1, 42) for _ in range(2))
    val = {r.sample_id for r in first.filter("split = 'val'").collect()}
    assert len(val) == 10 and first.count() == 105
    assert val == {r.sample_id for r in again.filter("split = 'val'").collect()}
    assert splits.random_split(ids.limit(3), 0.1).filter("split = 'val'").count() == 1


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "sample_id long, label long")


def test_stratified_split_of_equal_classes(spark):
    rows = labelled(spark, [i % 10 for i in range(1000)])
    found = splits.stratified_split(rows, 200, 42)
    val = found.filter("split = 'val'").join(rows, "sample_id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in val} == {i: 20 for i in range(10)}


@pytest.mark.parametrize("val_size", [1, 2, 5, 9])
def test_stratified_split_has_the_size_asked_for(spark, val_size):
    rows = labelled(spark, [0, 0, 0, 0, 0, 1, 1, 2, 3, 4])
    found = splits.stratified_split(rows, val_size)
    assert found.count() == 10 and found.filter("split = 'val'").count() == val_size


def test_class_of_one_goes_to_validation(spark):
    rows = labelled(spark, [0] + [1] * 9)
    found = splits.stratified_split(rows, 3).filter("split = 'val'").collect()
    assert 0 in {r.sample_id for r in found}


def test_stratified_split_refuses_bad_sizes(spark):
    for size in (0, 3):
        with pytest.raises(ValueError):
            splits.stratified_split(labelled(spark, [0, 0, 1]), size)


HIDDEN = "sample_id long, layer int, token_pos int, vector array<float>"


def test_token_rows(spark):
    rows = [(1, layer, t, [float(layer), float(t)]) for layer in range(3) for t in range(4)]
    rows += [(2, 0, 0, [1.0, 1.0]), (2, 1, 0, [2.0, 4.0])]
    hidden = spark.createDataFrame(rows, HIDDEN)
    assert prep.cap_tokens(hidden, 2).count() == 8
    assert prep.drop_embedding_layer(hidden).count() == 9
    last = {(r.sample_id, r.layer) for r in prep.last_layer(hidden).collect()}
    assert last == {(1, 2), (2, 1)}
    pooled = {r.sample_id: r.features for r in prep.mean_pool(prep.last_layer(hidden)).collect()}
    assert pooled == {1: [2.0, 1.5], 2: [2.0, 4.0]}


def test_feature_map_points(spark):
    maps = spark.createDataFrame([(1, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "sample_id long, feature_map array<array<double>>")
    found = prep.feature_map_points(maps).orderBy("position").collect()
    assert [r.point for r in found] == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]


def test_counted_model_losses(spark):
    import math

    rows = frame(spark, ["ababa"])
    chunks = prep.chunk_texts(rows, 4)
    model = model_outputs.fit_bigrams(chunks, 2)
    losses = model_outputs.token_losses(chunks, model, ["doc_id", "chunk_idx"]).orderBy("token_pos")
    expected = [-math.log(3 / 4)] * 4
    assert [r.loss for r in losses.collect()] == pytest.approx(expected)
    entropies = {r.context: r.entropy for r in model_outputs.context_entropies(model, 2).collect()}
    p = [0.75, 0.25]
    assert entropies["a"] == pytest.approx(-sum(x * math.log(x + 1e-10) for x in p))
    row = model_outputs.chunk_losses(chunks, model, ["doc_id"]).first()
    assert (row.n, row.first_target) == (4, ord("b")) and row.loss == pytest.approx(expected[0])


@pytest.mark.parametrize("limit", [0, 10_000])
def test_losses_of_a_large_model(spark, monkeypatch, limit):
    """The joined path and the one with arrays give the same; the latter moves no row."""
    import math
    import random
    from collections import Counter

    draw = random.Random(1)
    texts = ["".join(chr(draw.choice([97, 98, 0x4E00 + draw.randrange(30), 0x1F600])) for _ in range(draw.randrange(60))) for _ in range(40)]
    monkeypatch.setattr(model_outputs, "MODEL_PAIRS", limit)
    chunks = prep.chunk_texts(frame(spark, texts), 8)
    model = model_outputs.fit_bigrams(chunks, 33)
    pairs, contexts = Counter(), Counter()
    pieces = {(i, j): t[9 * j : 9 * j + 9] for i, t in enumerate(texts) for j in range(-(-len(t) // 9))}
    for piece in pieces.values():
        for a, b in zip(piece, piece[1:]):
            pairs[a, b] += 1
            contexts[a] += 1
    loss = lambda a, b: -math.log((pairs[a, b] + 1) / (contexts[a] + 33))
    scored = model_outputs.chunk_token_losses(chunks, model, ["doc_id", "chunk_idx"])
    found = {(r.doc_id, r.chunk_idx): r for r in scored.collect()}
    assert set(found) == set(pieces)
    for key, piece in pieces.items():
        assert found[key].losses == pytest.approx([loss(a, b) for a, b in zip(piece, piece[1:])])
        assert found[key].first_target == (ord(piece[1]) if len(piece) > 1 else None)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (limit == 0)


def test_a_function_on_texts_gets_slices_of_a_batch(spark, monkeypatch):
    """Before, it got a whole batch at once: up to 64 MB of text as Python strings."""
    monkeypatch.setattr(prep, "TEXT_BYTES", 100, raising=False)
    texts = ["abcdé" * n for n in (1, 0, 3, 40, 2, 5, 7, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["sample_id", "text"])
    parts = list(prep._slices(batch, "text"))
    assert sum((p.column("sample_id").to_pylist() for p in parts), []) == list(range(9))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()[:-1]) < 100 for p in parts)
    assert len(parts) >= 3 and list(prep._slices(batch.slice(0, 0), "text")) == []
    frame = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string").coalesce(1)
    seen = prep.text_features(frame, lambda given: np.array([[len(given), len(t or "")] for t in given], float))
    assert [r.features[1] for r in seen.orderBy("sample_id").collect()] == [len(t or "") for t in texts]
