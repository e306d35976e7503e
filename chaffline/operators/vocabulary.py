"""Character vocabulary: fit, encode, decode."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffline.functions.text import characters

# The printable ASCII range that ids are clamped to when there is no vocabulary.
FIRST_PRINTABLE = 32
LAST_PRINTABLE = 126


# Code points that Unicode has.
CODE_POINTS = 0x110000


def _characters_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct characters of all texts of a task."""
    met = np.zeros(CODE_POINTS, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            met[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)] = True
    yield pa.RecordBatch.from_arrays([pa.array(map(chr, np.flatnonzero(met).tolist()), pa.string())], ["ch"])


def build_vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """(ch, token_id): the distinct characters by code point, ids dense from 0.

    Each task gives its distinct characters only, so few rows are shuffled. The window sees
    distinct characters, of which Unicode has at most 1,114,112.
    """
    distinct = texts.select(column).mapInArrow(_characters_met, "ch string").distinct()
    numbered = F.expr("row_number() over (order by ch)") - 1
    return distinct.select("ch", numbered.cast("int").alias("token_id"))


class Codec:
    """A fitted vocabulary as two constant arrays for use inside a projection.

    `codes[code point]` is the token id and `symbols[token id]` the character, so a character
    costs one array read. Both are bounded by the size of Unicode; they are written as constants
    that Spark folds into array literals, as a subquery cannot be used inside a lambda.
    """

    def __init__(self, symbols: Sequence[str]) -> None:
        self.size = len(symbols)
        ids = {ord(symbol): token_id for token_id, symbol in enumerate(symbols)}
        known = (str(ids.get(point, -1)) for point in range(max(ids, default=0) + 1))
        self._codes = F.split(F.lit(",".join(known)), ",").cast("array<int>")
        self._symbols = characters(F.lit("".join(symbols)))

    @classmethod
    def fit(cls, texts: DataFrame, column: str = "text") -> Codec:
        rows = build_vocabulary(texts, column).orderBy("token_id").collect()
        return cls([r.ch for r in rows])

    def token_of(self, code_point: Column) -> Column:
        """The token id of a code point, below 0 or NULL if it is unknown."""
        return F.get(self._codes, code_point)

    def encode(self, text: Column) -> Column:
        """Token ids of a text; an unknown character is an error."""

        def token(ch: Column) -> Column:
            found = self.token_of(F.ascii(ch))
            unknown = F.concat(F.lit("character not in the vocabulary: "), ch)
            return F.when(found >= 0, found).otherwise(F.raise_error(unknown).cast("int"))

        return F.transform(characters(text), token)

    def decode(self, tokens: Column, unknown: str = "") -> Column:
        """The text of token ids; ids outside the vocabulary become `unknown`."""
        symbol = lambda i: F.coalesce(F.get(self._symbols, i), F.lit(unknown))
        return F.array_join(F.transform(tokens, symbol), "")


def decode_without_vocabulary(tokens: Column) -> Column:
    """Ids read as ASCII codes, clamped to the printable range."""
    clamped = F.transform(
        tokens,
        lambda i: F.char(F.greatest(F.lit(FIRST_PRINTABLE), F.least(F.lit(LAST_PRINTABLE), i))),
    )
    return F.array_join(clamped, "")
