"""Vector functions on array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _total(F.zip_with(a, b, term))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    """``v`` over its length as floats; a zero vector has no direction and gives null."""
    # Repeated beside the values: inside a lambda the length would be computed per value.
    lengths = F.array_repeat(l2_norm(v), F.size(v))
    scaled = F.zip_with(v, lengths, lambda x, n: (x.cast("double") / n).cast("float"))
    return F.when(F.exists(v, lambda x: x != 0), scaled)


def similarity_score(distance: Column) -> Column:
    return 1 / (1 + distance)
