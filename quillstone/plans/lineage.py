"""What assertions are derived from, over any number of steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.terms import json_map
from quillstone.functions.text import string_attribute
from quillstone.plans.extensions import sources
from quillstone.plans.shared import forget, written

KIND = "source_assertion_ids"
#: Pairs of a stride for each link at most.
WIDE = 4


@dataclass(frozen=True)
class Closure:
    """(assertion_id, source_id, steps): each source that an assertion reaches, with the least number of steps; and the assertions that reach
    themselves."""

    reached: DataFrame
    cyclic: DataFrame
    steps: int


def links(df: DataFrame) -> DataFrame:
    """(assertion_id, source_id): what rows name as the assertions that they come from; each pair once."""
    named = sources(df).where(F.col("source_kind") == KIND).select("ingest_seq", F.btrim("source_id").alias("source_id"))
    return named.join(df.select("ingest_seq", "assertion_id"), "ingest_seq").select("assertion_id", "source_id").distinct()


def dangling(df: DataFrame) -> DataFrame:
    """(assertion_id, source_id): named sources that no row has."""
    return links(df).join(df.select(F.col("assertion_id").alias("source_id")), "source_id", "left_anti").select("assertion_id", "source_id")


def closure(df: DataFrame, seeds: DataFrame | None = None) -> Closure:
    """All sources of the rows of ``df``, or of the assertions in ``seeds`` (one column of ids). Rows without sources reach nothing; an id that several rows
    have stands for all of them.

    Ways are doubled: where all pairs of up to n steps are known, a shortest way of n + 1 to n + stride steps is one of more than n - stride steps to
    a pair of exactly ``stride`` steps. The stride is the largest power of two up to n with no more than WIDE times as many pairs as there are links, so chains take
    the logarithm of their length in rounds, and dense graphs, whose far pairs are very many, are followed by links alone. It ends with the round
    that finds no new pair, in cycles too. Strides are those of all rows; with ``seeds`` the ways begin there, and only links are followed."""
    spark = df.sparkSession
    held, links_path = written(links(df))
    first = held
    if seeds is not None:
        first = held.join(seeds.select(F.col(seeds.columns[0]).alias("assertion_id")).distinct(), "assertion_id", "left_semi")
    fresh, path = written(first.withColumn("steps", F.lit(1)))
    paths, counts, known = [path], {1: fresh.count()}, 1
    most = WIDE * held.count() if seeds is None else 0
    while counts.get(known):
        stride = 1
        while 2 * stride <= known and counts[2 * stride] <= most:
            stride *= 2
        reached = spark.read.parquet(*paths)
        by = (held.withColumn("steps", F.lit(1)) if stride == 1 else reached.where(F.col("steps") == stride)).select(F.col("assertion_id").alias("source_id"), F.col("source_id").alias("further"))
        met = reached.where(F.col("steps") > known - stride).join(by, "source_id").groupBy("assertion_id", F.col("further").alias("source_id")).agg(F.min("steps").alias("steps"))
        fresh, path = written(met.join(reached.select("assertion_id", "source_id"), ["assertion_id", "source_id"], "left_anti").withColumn("steps", F.col("steps") + stride))
        paths.append(path)
        counts |= {r["steps"]: r["count"] for r in fresh.groupBy("steps").count().collect()}
        known += stride
    reached = spark.read.parquet(*paths)
    forget(spark, links_path)
    return Closure(reached, reached.where("assertion_id = source_id").select("assertion_id", "steps"), max((n for n in counts if counts[n]), default=0))


def source_fingerprints(df: DataFrame) -> DataFrame:
    """(assertion_id, fingerprint, n_sources): of each row with sources a digest of what these assertions say now, in the order of their ids; a missing one
    counts as empty. Only a row's own sources are gathered, each as a digest."""
    said = df.select(F.col("assertion_id").alias("source_id"), F.sha2(F.to_json(F.struct("subject", "predicate", "object", "observed_at")), 256).alias("said"))
    said = said.groupBy("source_id").agg(F.min("said").alias("said"))
    named = links(df).join(said, "source_id", "left").select("assertion_id", F.concat_ws(":", "source_id", F.coalesce("said", F.lit(""))).alias("one"))
    each = named.groupBy("assertion_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return each.select("assertion_id", F.sha2(F.array_join("all", "\n"), 256).alias("fingerprint"), F.size("all").alias("n_sources"))


def changed_sources(df: DataFrame) -> DataFrame:
    """(assertion_id, was, now): derived rows whose attribute ``source_fingerprint`` is not that of their sources as they are."""
    was = string_attribute(json_map(F.col("attributes_json")), "source_fingerprint")
    told = df.select("assertion_id", was.alias("was")).where("was IS NOT NULL")
    return told.join(source_fingerprints(df).select("assertion_id", F.col("fingerprint").alias("now")), "assertion_id", "left").where(~F.col("was").eqNullSafe(F.col("now")))
