"""Expressions over vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_norm(a: Column | str) -> Column:
    return F.aggregate(F.transform(_col(a), lambda p: p * p), F.lit(0.0), lambda s, v: s + v)


def rounded(a: Column | str, digits: int = 6) -> Column:
    """Rounded to compare across engines; negative zero becomes zero."""
    return F.transform(_col(a), lambda p: F.round(p, digits) + 0.0)


def gaussian(d: Column | str, sigma: Column | str) -> Column:
    """exp(-d^2 / (2 sigma^2))."""
    return F.exp(-(_col(d) * _col(d)) / (2.0 * _col(sigma) * _col(sigma)))


def grid_distance(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    return F.sqrt((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2).cast("double"))
