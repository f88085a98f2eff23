"""Scalar functions on vectors (array<double>), distances and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos(a, b); null if either is a zero vector. Norms may be given where they are at hand."""
    return 1 - F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def combined_norm_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a|^2 + |b|^2): not a cosine, kept for comparison."""
    return 1 - F.try_divide(dot(a, b), dot(a, a) + dot(b, b))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def angle(distance: Column) -> Column:
    """The angle at a cosine distance, with rounding kept inside acos's domain."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


def half_angle_radius(distance: Column) -> Column:
    return 1 - F.cos(angle(distance) / 2)


def join_limit(n: Column, alpha: float) -> Column:
    """How near a document must be to join a proto-cluster of n members."""
    return F.lit(alpha) / (F.log(1 + n) + 1)


def merge_limit(n: Column, alpha: float) -> Column:
    """How near a topic must be to merge with one of n documents."""
    return F.lit(alpha) / (F.log(n) + 1)


def decayed(ticks: Column, rate: float) -> Column:
    return F.pow(F.lit(2.0), F.lit(-rate) * ticks)


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))
