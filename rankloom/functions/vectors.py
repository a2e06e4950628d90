"""Arithmetic on array columns, JVM-side and in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-9) -> Column:
    """v over its length plus eps.  The length stands outside the inner function, so that it is computed once for a vector and not for each coordinate."""
    return F.transform(F.array(norm(v) + F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))[0]


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
