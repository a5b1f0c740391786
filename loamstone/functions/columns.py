"""Small helpers on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def cosine_unit(a: Column, b: Column) -> Column:
    """Cosine moved to [0, 1]; 0.5 for missing, empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cos = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / norm + 1) / 2))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), cos), F.lit(0.5))
