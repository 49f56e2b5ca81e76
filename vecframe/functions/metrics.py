"""Similarities and distances as Columns, and the same over blocks of rows as matrix kernels.

Scores are computed in double. Every metric has a direction: cosine and inner product are better when higher, the
others when lower. A metric registry takes further ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecframe.errors import SearchError


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| of arrays of 64-bit words; two empty sets are equal."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, F.lit(0.0)).otherwise(1.0 - both / F.nullif(either, F.lit(0)).cast("double"))


def words_of(binary: Column, size: int) -> Column:
    """The 64-bit words of a binary column of ``size`` bytes (a multiple of eight)."""
    return F.array(*[F.conv(F.hex(F.substring(binary, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(size // 8)])


def sign_words(vector: Column, dim: int) -> Column:
    """Sign bits of a vector as 64-bit words, bit i of a word for component i (1: positive)."""

    def word(at: int) -> Column:
        bits = [F.when(F.get(vector, F.lit(at + i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(min(64, dim - at))]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return F.array(*[word(at) for at in range(0, dim, 64)])


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable[[Column, Column], Column]
    higher_is_better: bool
    #: Scores of query rows against corpus rows, in double; NaN where there is none.
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def _block_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(n > 0, (q @ x.T) / n, np.nan)


def _block_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    return np.maximum(s, 0.0)


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("COSINE", cosine, True, _block_cosine),
        Metric("IP", dot, True, lambda q, x: q @ x.T),
        Metric("L2", squared_l2, False, _block_l2),
        Metric("HAMMING", hamming, False),
        Metric("JACCARD", jaccard, False),
    )
}


def register_metric(metric: Metric) -> None:
    METRICS[metric.name.upper()] = metric


def metric(name: str) -> Metric:
    try:
        return METRICS[name.upper()]
    except KeyError:
        raise SearchError(f"no metric {name!r}") from None
