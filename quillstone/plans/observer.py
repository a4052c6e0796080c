"""Read-only views around some of a store's rows: their neighbourhood, and what they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.request import AssertionQuery
from quillstone.plans import lineage
from quillstone.plans.extensions import Walk, sources, walk


@dataclass(frozen=True)
class Neighbourhood:
    """The walk, and the assertions of its edges with the ``depth`` and ``path`` at which each was met."""

    walk: Walk
    assertions: DataFrame


def neighbourhood(frame: DataFrame, seeds: DataFrame, q: AssertionQuery | None = None, **bounds: object) -> Neighbourhood:
    """What lies around the terms in ``seeds``, within the bounds of ``walk``."""
    found = walk(frame, seeds, q, **bounds)
    met = found.edges.select("ingest_seq", "depth", "path")
    return Neighbourhood(found, frame.join(met, "ingest_seq"))


@dataclass(frozen=True)
class Lineage:
    """Of some assertions: all rows that they come from, with ``steps``, the other things that they or those name as sources, and named assertions
    that no row is."""

    assertions: DataFrame
    other_sources: DataFrame
    missing: DataFrame


def lineage_of(frame: DataFrame, seeds: DataFrame) -> Lineage:
    """``seeds`` has one column of assertion ids. A source that several seeds reach counts once, with its least number of steps."""
    ids = seeds.select(F.col(seeds.columns[0]).cast("string").alias("assertion_id")).distinct()
    reached = lineage.closure(frame, ids).reached
    steps = reached.select(F.col("source_id").alias("assertion_id"), "steps").unionByName(ids.withColumn("steps", F.lit(0))).groupBy("assertion_id").agg(F.min("steps").alias("steps"))
    rows = frame.join(steps, "assertion_id")
    other = sources(rows).where(F.col("source_kind") != lineage.KIND)
    return Lineage(rows, other, steps.where("steps > 0").join(frame.select("assertion_id"), "assertion_id", "left_anti"))
