"""Vectors and sets in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, least: float = 1e-12) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.greatest(n, F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Share of the common elements; both_empty is the value of two empty sets."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / either)


def fitted(v: Column, width: int) -> Column:
    """Cut or padded with zeros to a width."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def parsed(text: Column, fewest: int = 1) -> Column:
    """A vector from text such as "[0.1 -2e-3, ...]", with terminal codes in it perhaps; null below `fewest` numbers."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", " "), r"[\[\],]", " ")
    numbers = F.filter(F.transform(F.split(F.trim(plain), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) >= fewest, numbers)


def differences(v: Column) -> Column:
    n = F.size(v)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(v, 2, n - 1), F.slice(v, 1, n - 1), lambda a, b: a - b))


def std_pop(v: Column) -> Column:
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
