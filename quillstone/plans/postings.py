"""An inverted index of the words of texts: for each word the numbers of the rows that have it, rising, in chunks of CHUNK numbers.

Each folder of a dataset may hold the postings of its own rows, sorted by word, so that a search reads the row groups of its words only. Words are
intersected chunk by chunk from the rarest, so what is joined is never more than that word's chunks; a word that very many rows have is
many chunks, and no row of the index is longer than CHUNK.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.extensions import words_of

CHUNK = 1 << 16


def postings(rows: DataFrame) -> DataFrame:
    """(word, chunk, numbers) of rows with ``ingest_seq`` and ``text``."""
    each = rows.select("ingest_seq", F.explode(words_of(F.col("text"))).alias("word"))
    chunk = F.floor(F.col("ingest_seq") / CHUNK).alias("chunk")
    return each.groupBy("word", chunk).agg(F.sort_array(F.collect_list("ingest_seq")).alias("numbers"))


def write(rows: DataFrame, path: str) -> None:
    postings(rows).repartitionByRange("word", "chunk").sortWithinPartitions("word", "chunk").write.parquet(path)


def having_all(index: DataFrame, words: list[str]) -> DataFrame:
    """(chunk, numbers): the rows that have every one of ``words``, which are distinct; none if there is no word."""
    if not words:
        return index.where(F.lit(False)).select("chunk", "numbers")
    own = index.where(F.col("word").isin(*words))
    sizes = {r["word"]: r["n"] for r in own.groupBy("word").agg(F.sum(F.size("numbers")).alias("n")).collect()}
    if len(sizes) < len(words):
        return own.where(F.lit(False)).select("chunk", "numbers")
    rarest_first = sorted(words, key=lambda w: (sizes[w], w))
    found = [own.where(F.col("word") == w).groupBy("chunk").agg(F.flatten(F.collect_list("numbers")).alias("numbers")) for w in rarest_first]

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.join(b.withColumnRenamed("numbers", "others"), "chunk")
        return met.select("chunk", F.array_intersect("numbers", "others").alias("numbers")).where(F.size("numbers") > 0)

    return reduce(both, found)
