"""A table of vectors by what their texts say: each distinct text goes to the endpoint once.

Texts are known by the digest of their characters. Those that the table lacks are dealt to parts of PART_TEXTS by digest; a part is embedded by as many tasks as
requests may be in flight, written, and made to count by one rename, so a loss repeats the part that was being written and no other. A request that
fails is tried again a few times, with longer and longer waits.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.shared import checkpointed, forget, made_folder, names_in, renamed, written
from quillstone.sources.embedders import TextEmbedder

PART_TEXTS = 100_000
SCHEMA = "digest string, vector array<double>"


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def patient(embedder: TextEmbedder, texts: list[str], tries: int, wait_s: float) -> list[list[float]]:
    """The embedder's answer; its last error if it fails ``tries`` times."""
    for n in range(1, tries + 1):
        try:
            return embedder.embed_texts(texts)
        except RuntimeError:
            if n == tries:
                raise
            time.sleep(wait_s * 2 ** (n - 1))
    raise ValueError("tries must be 1 or more")


class VectorTable:
    """Vectors at ``path``. ``in_flight`` requests of ``batch`` texts at most run at once."""

    def __init__(self, spark: SparkSession, path: str, *, in_flight: int = 8, batch: int = 64, tries: int = 4, wait_s: float = 0.5) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.in_flight, self.batch, self.tries, self.wait_s = in_flight, batch, tries, wait_s

    def frame(self) -> DataFrame:
        """(digest, vector) of all texts that are known."""
        parts = [n for n in names_in(self.spark, self.path) if n.startswith("part=")]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in parts))

    def learn(self, texts: DataFrame, make_embedder: Callable[[], TextEmbedder]) -> int:
        """Embeds what the table lacks of the texts in the one column of ``texts``; returns how many that were. A text for which the embedder gives no vector
        stays unknown, and is asked for again by the next call."""
        text = F.coalesce(F.col(texts.columns[0]).cast("string"), F.lit(""))
        told = texts.select(digest_of(text).alias("digest"), text.alias("text"))
        if names_in(self.spark, self.path):  # what is known is told by the digests alone, without the texts
            lacking = checkpointed(told.select("digest").distinct().join(self.frame().select("digest"), "digest", "left_anti"))
            if lacking.isEmpty():
                return 0
            told = told.join(lacking, "digest", "left_semi")
        missing, path = written(told.dropDuplicates(["digest"]))
        n = missing.count()
        parts = -(-n // PART_TEXTS)
        batch, tries, wait_s = self.batch, self.tries, self.wait_s

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            embedder = None
            for rows in batches:
                for begin in range(0, rows.num_rows, batch):
                    own = rows.slice(begin, batch)
                    embedder = embedder or make_embedder()
                    vectors = patient(embedder, own.column(1).to_pylist(), tries, wait_s)[: own.num_rows]
                    made = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(0, len(made)), made], ["digest", "vector"])

        for part in range(parts):
            own = missing.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part)
            pending, number = f"{self.path}/_pending-{uuid.uuid4()}", uuid.uuid4()
            made_folder(self.spark, self.path)
            # many files need no shuffle to become as many tasks
            own = own.coalesce(self.in_flight) if own.rdd.getNumPartitions() >= self.in_flight else own.repartition(self.in_flight)
            own.mapInArrow(embed, SCHEMA).write.parquet(pending)
            renamed(self.spark, pending, f"{self.path}/part={number}")
        forget(self.spark, path)
        return n

    def joined(self, rows: DataFrame, text: str, name: str = "vector") -> DataFrame:
        """``rows`` with the vector of each one's text where ``name`` is null or absent."""
        known = self.frame().select(F.col("digest").alias("__digest"), F.col("vector").alias("__vector"))
        met = rows.withColumn("__digest", digest_of(F.col(text))).join(known, "__digest", "left")
        old = F.col(name) if name in rows.columns else F.lit(None).cast("array<double>")
        return met.withColumn(name, F.coalesce(old, F.col("__vector"))).drop("__digest", "__vector")
