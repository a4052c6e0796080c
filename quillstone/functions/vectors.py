"""Vector scores as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)).cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the length of the shorter vector; 0.0 if either is empty or has no length, null if a component is null."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, size), F.slice(b, 1, size)

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    lengths = [total(F.transform(v, lambda x: x * x)) for v in (a, b)]
    empty = (size <= 0) | (lengths[0] <= 0) | (lengths[1] <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(dot / (F.sqrt(lengths[0]) * F.sqrt(lengths[1])))
