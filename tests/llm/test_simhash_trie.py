import random

import numpy as np
import pytest
import xxhash

from chaffline.llm import components, simhash_trie


def mixed(value, part):
    mask = 2**64 - 1
    if part:
        value = (value + part * 0x9E3779B97F4A7C15) & mask
        value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 & mask
        value = (value ^ value >> 27) * 0x94D049BB133111EB & mask
        value ^= value >> 31
    return value


def brute_fingerprint(text, shingle, part=0):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [mixed(xxhash.xxh64_intdigest(s, 42), part) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, budget):
    """Smallest id reachable, for rows (id, value) or (id, list of values)."""
    values = np.array([np.atleast_1d(np.array(v, np.uint64)) for _, v in nodes])
    label = np.array([i for i, _ in nodes])
    while True:
        new = np.array([label[(np.bitwise_count(values ^ v) <= budget).any(1)].min() for v in values])
        if (new == label).all():
            return label.tolist()
        label = new


def test_odd_documents(odd_documents, odd_rows):
    found = simhash_trie.near_duplicates(odd_documents).collect()
    prints = [brute_fingerprint(t, 4) for _, t in odd_rows]
    known = [(d, p) for (d, _), p in zip(odd_rows, prints) if d is not None]
    label = dict(zip((p for _, p in known), brute_components(known, 4)))  # rows without an id link nothing
    expected = [(d, f"{p:016x}", label.get(p)) for (d, _), p in zip(odd_rows, prints)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("budget", [0, 1, 4, 8])
@pytest.mark.parametrize("piece", [100_000, 50])
def test_join_finds_what_all_pairs_find(spark, monkeypatch, budget, piece):
    monkeypatch.setattr(simhash_trie, "TRIE_ROWS", piece)
    rng = random.Random(budget)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 1}
    for base in list(values)[:60]:
        for _ in range(rng.randrange(6)):
            for bit in rng.sample(range(64), rng.randrange(1, 10)):
                base ^= 1 << bit
            values.add(base)
    nodes = [(i, v) for i, v in enumerate(sorted(values, key=lambda v: v * 2654435761 % 2**64))]
    signed = [(i, [v - 2**64 if v >> 63 else v]) for i, v in nodes]
    frame = spark.createDataFrame(signed, "node long, fingerprints array<long>")
    found = dict(components.components(simhash_trie.links(frame, budget)).collect())
    assert [found.get(i, i) for i, _ in nodes] == brute_components(nodes, budget)


@pytest.mark.parametrize("budget", [1, 4])
def test_crowded_nodes_are_cut_further(spark, budget):
    """Most fingerprints below one node: its pairs are dealt by further bits, and none is lost."""
    rng = random.Random(budget)
    values = {(0xABC << 52) | rng.getrandbits(52) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    for base in list(values):
        values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    nodes = sorted(values)
    signed = [(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(nodes)]
    frame = spark.createDataFrame(signed, "node long, fingerprint long")
    groups = {}
    for r in simhash_trie.prefix_pairs(frame, budget, rows_per_node=20).collect():
        groups.setdefault(r.trie, {}).setdefault(r.side, set()).add(r.node)
    met = set()
    for sides in groups.values():
        assert sum(map(len, sides.values())) < len(nodes) / 2
        pairs = [(a, b) for a in sides.get(-1, ()) for b in sides.get(-1, ())] + [(a, b) for a in sides.get(0, ()) for b in sides.get(1, ())]
        met |= {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    near = {(a, b) for a in range(len(nodes)) for b in range(a) if (nodes[a] ^ nodes[b]).bit_count() <= budget}
    assert {(b, a) for a, b in near} <= met


def test_node_pairs_are_walked_and_pruned(spark):
    """On real fingerprints the walk does the work: node pairs end by the budget, and fewer rows are compared than all."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    prints = {r.fingerprints[0] for r in simhash_trie.fingerprints(documents).collect()}
    values = np.sort(np.array(list(prints), np.int64).view(np.uint64))
    counts, n = {}, len(values)
    none = np.zeros(n, np.int64)
    pairs = sum(len(a) for a, _ in simhash_trie._join_tries(values, none - 1, none, 4, counts))
    every = sum(int((np.bitwise_count(values[i + 1 :] ^ v) <= 4).sum()) for i, v in enumerate(values))
    assert pairs >= every > 0
    assert counts["walked"] > 20 * n and counts["pruned"] > 20 * n
    assert counts["leaves"] * simhash_trie.LEAF_PAIRS < n * n / 2


def test_several_fingerprints(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = documents.collect()
    nodes = [(r.doc_id, [brute_fingerprint(r.text, 5, part) for part in range(3)]) for r in rows]
    found = {r.doc_id: r.component_id for r in simhash_trie.near_duplicates(documents, 5, 7, parts=3).collect()}
    assert [found[d] for d, _ in nodes] == brute_components(nodes, 7)
    assert len(set(found.values())) < len(rows)


def test_documents_against_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = documents.collect()
    prints = [brute_fingerprint(r.text, 4) for r in rows]
    labels = brute_components([(r.doc_id, p) for r, p in zip(rows, prints)], 4)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_trie.near_duplicates(documents).collect()}
    assert found == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, labels)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    found = dict(components.components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_empty_table(no_documents):
    assert simhash_trie.near_duplicates(no_documents).collect() == []
