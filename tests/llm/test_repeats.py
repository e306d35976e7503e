import hashlib
import random

import numpy as np
import pytest

from chaffline.llm import queries, repeats


def brute(rows, length):
    """(doc_id, bytes, spans, kept) by a table of all windows."""
    first = {}
    far = 2**63 - 1
    data = [(far if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, text in data:
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            first[window] = min(first.get(window, far), doc)
    out = []
    for doc, text in data:
        gone = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] < doc:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        kept = bytes(b for b, g in zip(text, gone[1:]) if not g)
        out.append((None if doc == far else doc, len(text), spans, kept))
    return sorted(out, key=str)


def found(frame, length, **dealt):
    rows = repeats.remove_repeats(frame, length, **dealt).collect()
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=str)


@pytest.mark.parametrize("length", [50, 8])
def test_odd_documents(odd_documents, odd_rows, length):
    assert found(odd_documents, length) == brute(odd_rows, length)


@pytest.mark.parametrize("seed, frequent, suffixes", [(0, 4096, 1 << 16), (1, 3, 1 << 16), (2, 4096, 40), (3, 1, 40)])
def test_mutated_copies_and_periods(spark, seed, frequent, suffixes):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(80):
        text = rng.choice(base)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["x", "", "é", "ab" * 40]) + text[at + rng.randrange(3) :]
        rows.append((rng.randrange(60), text))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = {"frequent": frequent, "suffixes": suffixes}
    assert found(frame, 50, **dealt) == brute(rows, 50)
    assert found(frame, 24, **dealt) == brute(rows, 24)


def test_documents_against_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in documents.collect()], 50)
    rows = queries.repeated_passages(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(
        (d, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in expected
    )


def test_frequent_anchors_are_dealt_by_window(odd_documents, odd_rows):
    block = repeats.Block.__new__(repeats.Block)
    texts = [(t or "").encode() for _, t in odd_rows]
    block.ids = np.arange(len(texts))
    block.edges = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
    block.bytes = np.frombuffer(b"".join(texts), np.uint8)
    hashes, first, count, owner = repeats.stretches(block, 50)
    runs, _, _ = repeats._distinct_anchors(hashes, owner, block.ids)
    every = np.packbits(np.ones(len(runs), bool)).tobytes()
    answers = [{"bucket": 0, "n": len(runs), "shared": every, "frequent": every}]
    _, own, start, many, _ = repeats._items(block, answers, 50, 1)
    assert (many == 1).all() and len(start) == count.sum()
    windows = {}
    for h, s in zip(own.tolist(), start.tolist()):
        assert windows.setdefault(h, block.bytes[s : s + 50].tobytes()) == block.bytes[s : s + 50].tobytes()


def test_interval_tree_gives_maximal_repeats():
    """Against all substrings: those that cannot be made longer without losing an occurrence."""
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice("ab") for _ in range(30))
        order = sorted(range(30), key=lambda i: text[i:])
        prefix = [0] + [len(_common(text[a:], text[b:])) for a, b in zip(order, order[1:])]
        prefix = np.array([p if p >= 2 else 0 for p in prefix])
        left = np.array([ord(text[i - 1]) if i else -1 for i in order])
        got = {text[order[a] : order[a] + n]: sorted(order[a : b + 1]) for n, a, b, _ in repeats.interval_tree(prefix, left, np.array(order), 2)}
        expected = {}
        for n in range(2, 30):
            for i in range(31 - n):
                word = text[i : i + n]
                at = [j for j in range(31 - n) if text[j : j + n] == word]
                before = {text[j - 1] if j else None for j in at}
                after = {text[j + n] if j + n < 30 else (None, j) for j in at}
                if len(at) > 1 and len(before) > 1 and len(after) > 1:
                    expected[word] = at
        assert got == expected


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def test_empty_table(no_documents):
    assert repeats.remove_repeats(no_documents).collect() == []
