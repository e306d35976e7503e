"""Hashed character grams of a batch of texts, used inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np

# Characters counted at once; bounds the memory of a task whatever the batch holds.
_CHARACTERS_AT_ONCE = 1 << 20
# Bits of a code point; three of them fit in one key.
_POINT_BITS = 21
# Grams have 3 characters, their bucket is the first 8 hex digits of the md5.
GRAM = 3
HEX_DIGITS = 8

Featurizer = Callable[[Sequence[str]], np.ndarray]


def _bucket(key: int, buckets: int) -> int:
    mask = (1 << _POINT_BITS) - 1
    gram = "".join(chr((key >> shift) & mask) for shift in (2 * _POINT_BITS, _POINT_BITS, 0))
    return int(hashlib.md5(gram.encode("utf-8")).hexdigest()[:HEX_DIGITS], 16) % buckets


def hashed_grams(buckets: int = 64) -> Featurizer:
    """A featurizer: counts of hashed 3-grams, scaled to length 1; zeros for shorter texts.

    A gram is hashed once per slice of texts, all other steps are array operations.
    """

    def count(texts: list[np.ndarray]) -> np.ndarray:
        points = np.concatenate(texts).astype(np.int64)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        keys = (points[:-2] << 2 * _POINT_BITS) | (points[1:-1] << _POINT_BITS) | points[2:]
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(keys)]
        inside = np.arange(len(keys)) < (starts + sizes - (GRAM - 1))[owner]
        distinct, which = np.unique(keys[inside], return_inverse=True)
        bucket = np.array([_bucket(int(k), buckets) for k in distinct], dtype=np.int64)
        cells = owner[inside] * buckets + bucket[which] if len(distinct) else owner[:0]
        return np.bincount(cells, minlength=len(texts) * buckets).reshape(len(texts), buckets)

    def featurize(texts: Sequence[str]) -> np.ndarray:
        parts, held, size = [], [], 0
        for text in texts:
            held.append(np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32))
            size += len(held[-1])
            if size >= _CHARACTERS_AT_ONCE:
                parts.append(count(held))
                held, size = [], 0
        if held:
            parts.append(count(held))
        counts = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, buckets))
        length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
        return counts / np.where(length > 0, length, 1.0)

    return featurize
