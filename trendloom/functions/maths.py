"""Numeric and set functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: dict, default=None) -> Column:
    """``table[key]``, or the default: a literal map, so no join."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    found = F.element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def age_minutes(at: Column, as_of: Column) -> Column:
    """Minutes from ``at`` to ``as_of``, 0 at least."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / 6e7)


def decay(age: Column, half_life: Column | float) -> Column:
    return F.exp(F.lit(-math.log(2)) * age / half_life)


def freshness_signal(age: Column) -> Column:
    return F.when((age > 0) & (age < float("inf")), 10 * F.exp(F.lit(-math.log(2)) * age / 45)).otherwise(10.0)


def step_decay(hours: Column) -> Column:
    return F.when(hours <= 1, 1.0).when(hours <= 3, 0.85).when(hours <= 6, 0.6).when(hours <= 12, 0.3).otherwise(0.0)


def change_rate(before: Column, now: Column) -> Column:
    """Jaccard distance of two id arrays as sets; 0 for two empty ones."""
    return 1 - jaccard(before, now)


def velocity_bonus(views: Column, comments: Column, likes: Column) -> Column:
    """1 to 1.5 from growth per hour."""
    return 1 + F.least((F.log1p(views) + 2.0 * F.log1p(comments) + 2.5 * F.log1p(likes)) / 10, F.lit(0.5))


def community_velocity_bonus(views: Column, comments: Column, likes: Column, has_likes: Column) -> Column:
    """1 to 1.6; where likes aren't known the other two make up for them."""
    known = F.log1p(views) + 3.0 * F.log1p(comments)
    return 1 + F.least(F.when(has_likes, known + 3.0 * F.log1p(likes)).otherwise(1.75 * known) / 8, F.lit(0.6))


def squash(z: Column, gain: float = 0.75, width: float = 1.5, floor: float = 0.5) -> Column:
    return F.greatest(F.lit(floor), 1 + gain * F.tanh(z / width))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0.01, a / b).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 for two empty ones, 0 for one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """The share of ``b``'s elements that ``a`` has."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def floor_percentile(values: Column, p: float) -> Column:
    """The element at floor(n p) of the sorted values, the last at most."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), (F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1).cast("int"))
