import hashlib
import re
from collections import defaultdict

import pytest

from chaffline.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((doc, len(text)))
    out = []
    for plain, own in groups.items():
        keep = min(own, key=lambda d: (-d[1], d[0] is None, d[0] or 0))[0]
        sha = hashlib.sha256(plain.encode()).hexdigest()
        out += [(d, keep, len(own), d == keep, sha) for d, _ in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 5, 40, 300])
def test_odd_documents(odd_documents, odd_rows, partitions):
    found = exact_dedup.exact_duplicates(odd_documents.repartition(partitions))
    assert sorted(map(tuple, found.collect()), key=str) == brute(odd_rows)


def test_a_third_of_all_rows_equal(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(64))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_table(no_documents):
    assert exact_dedup.exact_duplicates(no_documents).collect() == []


def test_no_python_in_the_plan(odd_documents, capsys):
    exact_dedup.exact_duplicates(odd_documents).explain("formatted")
    assert "Python" not in capsys.readouterr().out
