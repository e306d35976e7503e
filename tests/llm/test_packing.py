import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chaffline.llm import packing
from chaffline.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_ids_of_whole_texts(odd_rows, name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in odd_rows] * 2
    ids, counts = Encoder(path).encode(pa.array(texts, pa.string()))
    expected = [whole(path)(t) for t in texts]
    assert counts.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for e in expected for i in e]


def test_store_of_words_forgets_but_stays_right(odd_rows, monkeypatch):
    import pyarrow as pa

    from chaffline.llm import tokens

    monkeypatch.setattr(tokens, "STORED_WORDS", 20)
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 7)
    encoder, encode = Encoder(PATH), whole(PATH)
    for _ in range(3):
        for _, text in odd_rows:
            own = f"{text or ''} word\u241emark \u241e end{len(text or '')}"
            ids, counts = encoder.encode(pa.array([own, own]))
            assert ids.tolist() == encode(own) * 2 and counts[0] == counts[1]


def check(pieces, documents, capacity, end_id=1):
    """Documents come back whole, sequences are gapless and short enough; returns the padding share."""
    encode = whole(PATH)
    expected = Counter((d, tuple([*encode(t), end_id])) for d, t in documents)
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        parts[p["doc_id"], p["doc_tokens"]].append((p["start"], tuple(ids.tolist())))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    found = sum(len(ids) for v in parts.values() for _, ids in v)
    assert found == sum(len(ids) * n for (_, ids), n in expected.items())
    for (doc, tokens), own in parts.items():
        copies = [(ids, n) for (d, ids), n in expected.items() if d == doc and len(ids) == tokens]
        covered = Counter()
        for start, ids in own:
            assert any(full[start : start + len(ids)] == ids for full, _ in copies)
            covered.update(range(start, start + len(ids)))
        assert set(covered.values()) == {sum(n for _, n in copies)} and len(covered) == tokens
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


@pytest.mark.parametrize("capacity", [2048, 64])
def test_odd_documents(odd_documents, odd_rows, capacity):
    rows = packing.pack(odd_documents, PATH, capacity).collect()
    check(rows, odd_rows, capacity)


def test_little_padding_on_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(documents, PATH).collect()
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert check(rows, texts, 2048) < 0.01


def test_empty_table(no_documents):
    assert packing.pack(no_documents, PATH).collect() == []


def test_cut_covers_every_length():
    lengths = np.arange(1, 10_000)
    document, start, size = packing.cut(lengths, 2048)
    assert (np.bincount(document, weights=size) == lengths).all()
    first = np.searchsorted(document, np.arange(len(lengths)))
    assert (start[first] == 0).all() and (np.diff(start)[np.diff(document) == 0] == size[:-1][np.diff(document) == 0]).all()
    # A bin of a class is never over its capacity, and hardly under it.
    fill = 2048 // size * size
    assert (fill <= 2048).all() and (fill >= 2048 - 64).all()


def test_query_columns(spark):
    from chaffline.llm import queries

    found = queries.harmonic_packing(spark, "/root/testdata/sf0.001")
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for n, t in found.dtypes if n != "doc_id"} == {"bigint"}
    documents = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encode = whole(PATH)
    for r in found.orderBy(F.rand(3)).limit(60).collect():
        own = [*encode(documents[r.doc_id]), 1]
        data = np.array(own[r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and r.doc_tokens == len(own)
