"""What held at each of many instants.

Instants meet validities by time buckets: the borders of BUCKETS of them are drawn from a sample of the instants. A validity [from, until) covers a stretch of
buckets, which is cut into the fewest nodes of the binary tree over all buckets, two a level at most; an instant looks in the nodes above its bucket. Each
validity and instant that may meet do so at one node exactly, and are then compared as text, so results do not depend on the borders. A side that
is open reaches to the first or last bucket, so what always holds is the tree's root, and meets each instant once.

Each side has many rows for one of its table, which no estimate by the sizes of files knows of; so the sides meet by a shuffle, and neither is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.request import AssertionQuery, matching
from quillstone.plans.clustering import borders, rank

LEVELS = 10


def _nodes(first: Column, last: Column) -> Column:
    """The fewest nodes (level, number) that cover the buckets from ``first`` to ``last``."""
    start = F.struct(first.alias("a"), (last + 1).alias("b"), F.array().cast("array<struct<level:int,number:int>>").alias("nodes"))

    def step(s: Column, level: Column) -> Column:
        left = (s["a"] < s["b"]) & (s["a"] % 2 == 1)
        a = F.when(left, s["a"] + 1).otherwise(s["a"])
        right = (a < s["b"]) & (s["b"] % 2 == 1)
        b = F.when(right, s["b"] - 1).otherwise(s["b"])
        node = lambda n: F.array(F.struct(level.alias("level"), n.alias("number")))
        none = F.array().cast("array<struct<level:int,number:int>>")
        more = F.concat(s["nodes"], F.when(left, node(s["a"])).otherwise(none), F.when(right, node(b)).otherwise(none))
        return F.struct(F.floor(a / 2).cast("int").alias("a"), F.floor(b / 2).cast("int").alias("b"), more.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["nodes"])


def holding_at(df: DataFrame, instants: DataFrame, at: str = "at", on: Sequence[str] = ("subject",), q: AssertionQuery | None = None) -> DataFrame:
    """Each row of ``instants`` with the columns of each row of ``df`` that is within the query's conditions, equal in the columns ``on`` (which both have),
    and held at the instant: ``valid_from`` is null or no later, ``valid_until`` is null or later. Instants that are null meet nothing."""
    times = instants.where(F.col(at).isNotNull())
    between = borders(times, [at], LEVELS)[at]
    above = F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright("__bucket", n).alias("number")) for n in range(LEVELS + 1)))
    asked = times.withColumn("__bucket", rank(F.col(at), between)).withColumn("__node", F.explode(above)).drop("__bucket")
    first = rank(F.col("valid_from"), between)  # 0 where there is none
    last = F.when(F.col("valid_until").isNull(), (1 << LEVELS) - 1).otherwise(rank(F.col("valid_until"), between))
    held = matching(df, q or AssertionQuery()).withColumn("__node", F.explode(_nodes(first, last)))
    met = asked.join(held.hint("merge"), [*on, "__node"])
    true = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at)))
    return met.where(true).drop("__node")
