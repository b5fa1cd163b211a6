"""Arithmetic on ``ARRAY<DOUBLE>`` columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. Inside a lambda Spark would repeat it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """L2-normalise; a zero vector is returned as it is."""
    return bound(norm(v), lambda length: F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def as_text(v: Column, digits: int = 6) -> Column:
    """Fixed-point text of a vector, for exports and comparisons."""
    return F.array_join(F.transform(v, lambda x: F.format_string(f"%.{digits}f", x + F.lit(0.0))), " ")
