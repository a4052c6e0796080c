"""A corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, further ones too, whatever their names. Nulls, repeated rows, empty and very long texts and empty tables are treated as the
stages' operators say; of rows that are equal in key and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, lines, quality, similar
from quillstone.llm.catalogue import byte_bpe, table
from quillstone.plans.shared import forget, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"), name="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with earlier ones; those of which nothing is left go."""
    done = lines.deduplicate(docs, names=("__lines", "__removed"))
    left = (F.col("__removed") == 0) | (F.btrim("text", F.lit(lines.SPACES)) != "")
    return done.where(left | F.col("text").isNull()).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose five-word shingles link it at a similarity of 0.8 or more."""
    return similar.representatives(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, little-endian unsigned 32-bit integers, and digests of them and of what they decode to."""
    return byte_bpe(docs, "ids")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", new_lines),
    ("simhash", one_of_each),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: The model of the first stage and the alignment of the second can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result but the last is written to the shared folder, and goes when the
    next one is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES, 1):
        docs, before = stage(spark, docs, sf_dir), path
        if n < len(STAGES):
            docs, path = written(docs)
            if before:
                forget(spark, before)
    return docs
