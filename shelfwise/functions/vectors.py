"""Expressions over vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Divide by the Euclidean length; the zero vector stays zero.

    The division happens in the fold's last step, where the length is a value: inside a plain
    lambda it would be worked out again for every element.
    """
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x,
                       lambda s: F.transform(v, lambda x: x / F.greatest(F.sqrt(s), F.lit(1e-12))))


def scaled_sum(v: Column, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise (weighted) sum.

    One ``sum`` per position, so partial sums combine on the map side and a shuffled row is
    one vector per group and task rather than one row per element.
    """
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(F.get(v, F.lit(i)) * w) for i in range(dim)])


def mean_of(v: Column, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise (weighted) mean."""
    total = F.count(v) if weight is None else F.sum(F.when(v.isNotNull(), weight))
    return F.transform(scaled_sum(v, dim, weight), lambda x: x / total)


def rounded(v: Column, places: int = 6) -> Column:
    # + 0.0 turns a negative zero into zero
    return F.transform(v, lambda x: F.round(x, places) + F.lit(0.0))
