"""Column expressions over text, one character meaning one Unicode code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the weights of the character-quality score.
LETTERS = r"\p{L}+"
NUMBERS = r"\p{N}+"
SPACES = r"[\p{Z}\x09-\x0D\x1C-\x1F\x85]+"
ALPHA_WEIGHT = 0.4
DIVERSITY_WEIGHT = 0.3
SPACE_WEIGHT = 0.15
PUNCTUATION_WEIGHT = 0.15


def characters(text: Column) -> Column:
    """The characters of `text`; the empty element that splitting '' gives is dropped."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, length: int, whole_only: bool = False) -> Column:
    """Consecutive pieces of `length` characters, the last one shorter; dropped if `whole_only`."""
    least = length if whole_only else 1
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{length}}}"), F.lit(0))


def character_quality(text: Column) -> Column:
    """Weighted share of letters, distinct characters, non-spaces and non-punctuation.

    The classes are disjoint, so each is taken out in turn and counted by the loss of length.
    """
    no_letters = F.regexp_replace(text, LETTERS, "")
    no_words = F.regexp_replace(no_letters, NUMBERS, "")
    marks = F.regexp_replace(no_words, SPACES, "")
    size = F.greatest(F.length(text), F.lit(1))
    distinct = F.when(F.length(text) > 0, F.size(F.array_distinct(F.split(text, "")))).otherwise(0)
    return (
        (F.length(text) - F.length(no_letters)) / size * ALPHA_WEIGHT
        + distinct / size * DIVERSITY_WEIGHT
        + (F.lit(1.0) - (F.length(no_words) - F.length(marks)) / size) * SPACE_WEIGHT
        + (F.lit(1.0) - F.length(marks) / size) * PUNCTUATION_WEIGHT
    )
