"""The Spark side of the block labeller: see html_blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.html_blocks import Labeller, leaves
from quillstone.llm.html_training import training_pages
from quillstone.llm.words import slices

SLICE_BYTES = 1_000_000


def fit(pages: DataFrame, page: str, fit_pages: int, drawn: int) -> Labeller:
    """A labeller trained from the ``fit_pages`` distinct pages with the least hashes. The cut is found
    on the hashes alone, so no task sends pages that others displace."""
    usable = pages.where(F.col(page).isNotNull()).select(F.xxhash64(page).alias("order"), F.col(page).alias("page"))
    cut = usable.select("order").distinct().orderBy("order").limit(fit_pages).agg(F.max("order")).first()[0]
    chosen = usable.where(F.col("order") <= F.lit(cut)).groupBy("order").agg(F.min("page").alias("page"))
    found = sorted(chosen.collect(), key=lambda r: r["order"])
    return Labeller().fit(training_pages([r["page"] for r in found], drawn))


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", fit_pages: int = 150, drawn: int = 600) -> DataFrame:
    """``pages`` without ``page`` and with ``text``, its main text, and ``n_chars``."""
    plain = pages.withColumn(page, F.col(page).cast("string"))
    model = pages.sparkSession.sparkContext.broadcast(fit(plain, page, fit_pages, drawn))
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, length in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, length)
                texts = model.value.main_texts([leaves(p or "") for p in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string())], [*kept, "text"])

    at = len(kept)
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "text string"])
    return plain.select(*kept, page).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
