import hashlib
import random
import re

import numpy as np
import pytest

from chaffline.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, window):
    phrases = []
    for item, text in items:
        own = words(text)
        if item is not None and own:
            size = min(window, len(own))
            phrases.append((str(item), {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}, size))
    out = []
    for doc, text in documents:
        own, hit, found = words(text), set(), set()
        for item, parts, size in phrases:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in parts:
                    hit.update(range(i, i + size))
                    found.add(item)
        out.append((doc, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(frame, items, window):
    rows = decontaminate.decontaminate(frame, items, window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)


@pytest.mark.parametrize("window", [10, 3])
def test_odd_documents(spark, odd_documents, odd_rows, window):
    texts = [t for _, t in odd_rows if t]
    items = [(1, texts[15]), (2, "a b"), (3, "12 34"), (4, None), (5, "!!"), (None, "a b"), (7, "not there at all")]
    items += [(7, texts[16]), (10, " ".join(words(texts[16])[5:19])), (11, "a B!"), (11, "a B!"), (12, "日本語 テスト")]
    frame = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, segment int")
    assert found(odd_documents, frame, window) == brute(odd_rows, items, window)


def test_equal_words_in_phrases_and_documents(spark):
    rng = random.Random(1)
    documents = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    assert found(frame, spark.createDataFrame(items, "item_id long, text string"), 4) == brute(documents, items, 4)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda n: [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/{n}.parquet").collect()]
    rows = queries.decontamination(spark, folder).collect()
    expected = [
        (d, n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0)
        for d, n, hit, own in brute(read("documents"), read("benchmark"), 10)
    ]
    assert sorted(map(tuple, rows)) == sorted(expected)
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_proximity(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))) for _ in range(40)]
    phrases = ["a b c", "h g", "d", "a a b", "zz a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = decontaminate.build_index(frame, None, "doc_id", "text")
    asked = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {
        (r.doc_id, m.phrase): list(zip(m.first, m["last"]))
        for r in decontaminate.search(index, asked, within=5).collect() for m in r.matches
    }
    expected = {}
    for doc, text in enumerate(texts):
        own = text.split()
        for phrase in phrases:
            terms = set(phrase.split())
            spans = [
                (i, j) for i in range(len(own)) for j in range(i, min(i + 5, len(own)))
                if terms <= set(own[i : j + 1]) and not terms <= set(own[i + 1 : j + 1]) and not terms <= set(own[i:j])
            ]
            if spans:
                expected[doc, phrase] = spans
    assert got == expected


def test_empty_tables(spark, no_documents, odd_documents, odd_rows):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(no_documents, items, 10) == []
    assert found(odd_documents, items.limit(0), 10) == brute(odd_rows, [], 10)


def test_lists_are_intersected_from_the_rarest_on():
    rare, often = np.array([7, 90]), np.arange(100)
    assert decontaminate.phrase_starts([(2, rare), (0, often), (1, often)]).tolist() == [5, 88]


def test_more_than_128_partitions(spark):
    rows = [(i, f"a{i} b c d" if i % 3 else "x y z w") for i in range(300)]
    documents = spark.sparkContext.parallelize(rows, 300).toDF("doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    found = decontaminate.decontaminate(documents, benchmark, 3).collect()
    assert len({(r.segment, r.place) for r in found}) == 300
    assert {r.doc_id: r.n_hit for r in found} == {i: 0 if i % 3 else 3 for i, _ in rows}
