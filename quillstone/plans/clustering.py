"""How rows lie in files, so that a condition on any of several columns reads few of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the borders of ranks are drawn from at most, and the characters of a value that count.
SAMPLE = 10_000
CHARS = 64
BITS = 6
#: Borders from which a rank is looked up in an array, as a tree of comparisons would be too large to compile.
FEW = 1 << BITS


def borders(df: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list[str]]:
    """For each column the values between which its ranks lie: quantiles of a sample that is chosen by hash. They say where rows lie, never what an
    answer is."""
    cut = [F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, CHARS).alias(c) for c in columns]
    rows = df.select(*cut, F.xxhash64(*columns).alias("__h")).orderBy("__h").limit(sample).collect()
    out = {}
    for c in columns:
        values = sorted(r[c] for r in rows)
        out[c] = sorted({values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)} if values else [])
    return out


def rank(value: Column, between: Sequence[str]) -> Column:
    """How many of the rising ``between`` are no more than the value, by halving; below 2**n for 2**n - 1 of them."""
    if not between:
        return F.lit(0)
    if len(between) < FEW:  # comparisons that are compiled

        def half(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.lit(between[middle]) <= value, half(middle + 1, high)).otherwise(half(low, middle))

        return half(0, len(between))
    held = F.array(*map(F.lit, between))
    steps = [1 << i for i in reversed(range(len(between).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= value, at + step).otherwise(at))


def with_place(df: DataFrame, columns: Sequence[str], name: str, bits: int = BITS) -> DataFrame:
    """``df`` with a place on the Z-order curve through the ranks of the columns: rows near each other on it are near in each column."""
    between = borders(df, columns, bits)
    ranks = {f"{name}_{n}": rank(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, CHARS), between[c]) for n, c in enumerate(columns)}
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for n, r in enumerate(ranks):
            one = F.shiftright(r, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(columns) + n))
    return df.withColumns(ranks).withColumn(name, place).drop(*ranks)


def bloom_options(columns: Sequence[str], rows: int) -> dict[str, str]:
    """Writer options for Parquet's Bloom filters, by which a row group without a value is known."""
    options = {}
    for c in columns:
        options[f"parquet.bloom.filter.enabled#{c}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{c}"] = str(max(1, rows))
    return options
