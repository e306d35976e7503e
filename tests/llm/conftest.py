import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # Names that the operators use for columns of their own.
    + [T.StructField(n, T.StringType()) for n in ("run", "digest", "segment", "node", "row", "n", "ids", "block", "label")]
)


def _rows():
    rng = random.Random(5)
    words = ["the", "on", "ner", "über", "día", "x1", "Foo", "bar."]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60)
    texts = [
        None, "", " ", "\t\n", "a", "A b", "Hello  world", " lead and trail ", "nbsp here x", "one\x00two three",
        "tabs\there\r\nand lines", "don't 'quote' it's", "<|endoftext|> is a token", "a <|endoftext|> b<|endoftext|>", "x<|startoftext|>  y <|endoftext|><|ENDOFTEXT|>", "<|endoftext|>", "é combining ́ mark", "日本語 テスト 文",
        "emoji 🙂 🙂🙂 x", prose(3000), prose(40), prose(41) + "  " + prose(5), shared, "pre " + shared + " post",
        shared.upper(), shared + " " + shared, "ab" * 400, "ab" * 400 + "c", "z" * 49, "z" * 50, "q z" + "z" * 50, "12 34",
        "\x0b\x0cform", "x y z", prose(2047),
    ]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[19], rows[19]]  # repeated rows
    rows += [(500 + i, shared) for i in range(7)]  # copies
    rows += [(600, shared.replace(" ", "")), (601, shared + " \n"), (None, "null id text " + shared), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    """Nulls, empty, long, repeated and tied rows, with columns that are in the operators' way."""
    full = [(*r, *["in the way"] * (len(SCHEMA) - 2)) for r in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
