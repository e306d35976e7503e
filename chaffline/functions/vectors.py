"""Column expressions over numeric arrays (vectors, logits, probabilities)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard inside the logarithm of the prediction entropy, shortest vector normalised.
ENTROPY_GUARD = 1e-10
SHORTEST_LENGTH = 1e-12


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    A column used inside a lambda over an array is computed again for every element; bound as
    the variable of an outer one-element lambda it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def length(values: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(values), F.lit(0.0), lambda acc, x: acc + x * x))


def shifted_powers(logits: Column) -> Column:
    """exp(x - max), safe from overflow."""
    return bind(
        F.array_max(as_doubles(logits)),
        lambda top: F.transform(as_doubles(logits), lambda x: F.exp(x - top)),
    )


def softmax(logits: Column) -> Column:
    return bind(
        shifted_powers(logits),
        lambda powers: bind(total(powers), lambda whole: F.transform(powers, lambda p: p / whole)),
    )


def log_sum_exp(logits: Column) -> Column:
    return F.array_max(as_doubles(logits)) + F.log(total(shifted_powers(logits)))


def argmax(values: Column) -> Column:
    """0-based index of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def entropy(probabilities: Column) -> Column:
    return F.aggregate(
        as_doubles(probabilities),
        F.lit(0.0),
        lambda acc, p: acc - p * F.log(p + F.lit(ENTROPY_GUARD)),
    )


def unit_vector(values: Column) -> Column:
    """The vector divided by its length; a (near) zero vector is left as it is."""
    return bind(
        length(values),
        lambda size: F.transform(
            as_doubles(values),
            lambda x: x / F.when(size < SHORTEST_LENGTH, 1.0).otherwise(size),
        ),
    )
