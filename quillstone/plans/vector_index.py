"""An inverted file over vectors that answers exactly.

Centres are fitted by k-means to SAMPLE vectors at most, chosen by hash; every row is then in the list of its nearest centre. A list's radius is the
largest angle between its centre and a row. By the triangle inequality no row of a list scores more than the cosine of the
question's angle to its centre less the radius, so lists that can't reach the score that counts are never read. Rows whose vectors are of another
length than most, or can't be compared, are in a list of their own (APART), which is always read; so are rows that were added later. So an
answer is that of a full scan. The lists are partitions of a copy of the rows; their centres and radii, LISTS at most, are read by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.request import AssertionQuery, by_score, matching

SAMPLE = 20_000
LISTS = 1024
ROUNDS = 10
APART = -1
#: Angles are widened by so much, for what rounding may have taken away.
ROUNDING = 1e-6


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def centres_of(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of unit vectors, by spherical k-means from vectors that are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = _unit(sums)
        centres = np.where((moved * moved).sum(1, keepdims=True) > 0, moved, centres)
    return np.unique(centres, axis=0)


def build(df: DataFrame, path: str, vector: str = "vector", lists: int | None = None, sample: int = SAMPLE) -> None:
    """Writes the lists of the rows of ``df`` that have a vector to ``path``."""
    spark, column = df.sparkSession, F.col(f"`{vector}`")
    rows = df.where(column.isNotNull())
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    sizes = rows.where(usable).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = sizes["n"] if sizes else 0
    lists = lists or min(LISTS, max(1, math.isqrt(sizes["count"]) if sizes else 1))
    chosen = rows.where(usable & (F.size(column) == size)).select(column.alias("v"), F.xxhash64("ingest_seq").alias("h")).orderBy("h").limit(sample)
    given = [r["v"] for r in chosen.select("v").collect()]
    centres = centres_of(_unit(np.array(given)), lists) if given else np.zeros((1, size))

    @F.pandas_udf("list int, angle double")
    def assigned(vectors: pd.Series) -> pd.DataFrame:
        own = vectors.notna().to_numpy()
        out = pd.DataFrame({"list": np.full(len(own), APART, np.int32), "angle": np.full(len(own), np.nan)})
        if own.any():
            product = _unit(np.stack(vectors[own].to_list())) @ centres.T
            at = product.argmax(1)
            out.loc[own, "list"] = at.astype(np.int32)
            out.loc[own, "angle"] = np.arccos(np.clip(product[np.arange(len(at)), at], -1, 1))
        return out

    placed = assigned(F.when(usable & (F.size(column) == size), column))
    full = rows.withColumn("__placed", placed).select("*", F.col("__placed.list").alias("list"), F.when(~F.isnan("__placed.angle"), F.col("__placed.angle")).alias("angle")).drop("__placed")
    # a large list is several ranges
    full.repartitionByRange("list", "ingest_seq").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    told = spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "list int, centre array<double>")
    told.join(known, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


@dataclass(frozen=True)
class Found:
    """The answer, and how many lists were read of how many."""

    rows: DataFrame
    lists_read: int
    lists: int


def bounds(lists: Sequence[dict], question: np.ndarray) -> dict[int, float]:
    """The most that a row of each list may score."""
    out = {}
    length = math.sqrt(float(question @ question))
    for row in lists:
        if row["list"] == APART or length == 0 or len(row["centre"]) != len(question):
            out[row["list"]] = math.inf
            continue
        angle = math.acos(max(-1.0, min(1.0, float(question @ np.array(row["centre"])) / length)))
        out[row["list"]] = math.cos(max(0.0, angle - row["radius"] - ROUNDING)) + ROUNDING
    return out


def search(spark: SparkSession, path: str, q: AssertionQuery, vector: Sequence[float], later: DataFrame | None = None) -> Found:
    """``by_score`` over the rows of an index and those in ``later``: first in the lists that may hold the best rows, then, knowing the last score
    that counts there, in all that may reach it."""
    lists = [r.asDict() for r in spark.read.parquet(f"{path}/lists").collect()]
    bound = bounds(lists, np.array(vector, float))
    rows = spark.read.parquet(f"{path}/rows")

    def within(some: list[int]) -> DataFrame:
        own = rows.where(F.col("list").isin(some)).drop("list", "angle")
        return matching(own if later is None else own.unionByName(later.select(*own.columns)), q)

    least = -math.inf if q.min_score is None else q.min_score
    if q.rows is not None and lists:
        best, n = [], 0
        for row in sorted(lists, key=lambda r: -bound[r["list"]]):
            best.append(row["list"])
            n += row["n"]
            if n >= q.rows and bound[row["list"]] < math.inf:
                break
        last = by_score(within(best), q, vector).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        if last["n"] == q.rows:
            least = max(least, last["score"])
    read = [r["list"] for r in lists if bound[r["list"]] >= least]
    return Found(by_score(within(read), q, vector), len(read), len(lists))
