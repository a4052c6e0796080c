"""Connected components of a graph by alternating large-star and small-star steps.

Each step is a group-by and a join over the edges, which are held as a table of longs; nothing is gathered on
the driver. After every round the edges are written to the shared folder, so that the plan stays short and a lost executor costs
one round at most; what the round before wrote is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.shared import forget, written


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node that it reaches) for every node of the edges (a, b), a unequal b."""
    pairs, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        # large star: a node's larger neighbours move to the least of its neighbours and itself
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        old = path
        pairs, path = written(small)
        forget(pairs.sparkSession, old)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
