import hashlib
import random

import pyarrow as pa
import pytest

from chaffline.llm import queries, substrings


def split(text):
    return (text or "").encode().split()


def brute(rows, size=13):
    """All windows of all documents in one dictionary."""
    least = {}
    for doc, text in rows:
        words = split(text)
        for i in range(len(words) - size + 1) if doc is not None else ():
            window = tuple(words[i : i + size])
            least[window] = min(least.get(window, doc), doc)
    out = []
    for doc, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - size + 1) if doc is not None else ():
            if least[tuple(words[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60):
    """Documents that share passages, with nested, overlapping, touching and short ones."""
    rng = random.Random(seed)
    prose = lambda k: [rng.choice("river stone the and cloud über x y".split()) + str(rng.randrange(40)) for _ in range(k)]
    shared = [prose(k) for k in (12, 13, 14, 30, 100)]
    rows = []
    for i in range(n):
        words = prose(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            own = rng.choice(shared)
            a = rng.randrange(max(1, len(own) - 12))
            words += own[a : a + rng.randrange(10, 60)] + prose(rng.choice([0, 0, 3, 20]))
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(words)))
    rows += [(100, " ".join("ab"[i % 2] for i in range(300))), (101, " ".join("ba"[i % 2] for i in range(40)))]
    rows += [(102, "z " * 5000), (103, "z " * 13), (104, "z " * 12), rows[3], (5, rows[7][1]), (200, rows[9][1].replace(" ", "  "))]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **other):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, words string, doc string")
    out = []
    for r in substrings.remove_repeated_spans(frame.repartition(4), **other).collect():
        spans = [(s["first"], s["last"]) for s in r.spans]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # maximal: spans never touch
        out.append((r.doc_id, r.n_words, sum(b - a for a, b in spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = passages(seed)
    assert found(spark, rows) == brute(rows)


def test_small_shards_and_pieces(spark, monkeypatch):
    for name, value in (("SHARD_WINDOWS", 20), ("STREAM_WINDOWS", 30), ("PLACE_BITS", 3), ("TOGETHER_BITS", 1), ("BROADCAST_SPANS", 3), ("TEXT_BYTES", 300)):
        monkeypatch.setattr(substrings, name, value)
    rows = passages(3, 40)
    assert found(spark, rows, size=6) == brute(rows, 6)


def test_equal_hashes_go_round_again(spark, monkeypatch):
    """With few bits most windows share a hash with others; the result is the same."""
    calls = []
    whole = substrings._round
    monkeypatch.setattr(substrings, "_round", lambda *a: calls.append(1) or whole(*a))
    rows = passages(4, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    covered = {}
    for r in substrings.repeated_spans(frame, 13, "doc_id", "text", bits=4).collect():
        covered.setdefault((r.doc, r.key), set()).update(range(r["first"], r["last"]))
    keys = {(r.doc_id, r.text): r.key for r in frame.selectExpr("doc_id", "text", "xxhash64(text) AS key").collect()}
    got = [(d, len(split(t)), len(covered.get((d, keys[d, t]), ()))) for d, t in rows]
    assert sorted(got) == sorted(b[:3] for b in brute(rows))
    assert len(calls) > 1


def test_query_on_odd_documents(spark, odd_documents, odd_rows, tmp_path):
    odd_documents.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in queries.substring_dedup(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == brute(odd_rows)


def test_empty_table(spark, no_documents):
    assert substrings.remove_repeated_spans(no_documents).collect() == []


def test_automaton_gives_matching_statistics():
    rng = random.Random(6)
    for _ in range(40):
        texts = [(rng.randrange(9), [rng.choice("abc") for _ in range(rng.randrange(1, 25))]) for _ in range(6)]
        automaton = substrings.SuffixAutomaton(texts)
        asked = [rng.choice("abcd") for _ in range(60)]
        for size in (1, 2, 4, 7):
            least = {}
            for doc, words in texts:
                for i in range(len(words) - size + 1):
                    w = tuple(words[i : i + size])
                    least[w] = min(least.get(w, doc), doc)
            expected = [(e, least[tuple(asked[e - size : e])]) for e in range(size, 61) if tuple(asked[e - size : e]) in least]
            assert list(automaton.matches(asked, size)) == expected


def test_words_are_found_as_split_finds_them(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    words = substrings.Words(pa.array(texts))
    own = [bytes(words.view[a:b]) for a, b in zip(words.begin, words.end)]
    assert own == [w for t in texts for w in split(t)]
    assert [own[a:b] for a, b in zip(words.edges, words.edges[1:])] == [split(t) for t in texts]
    by_word = {}
    for w, h in zip(own, words.hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
