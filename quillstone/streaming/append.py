"""Streaming appends: new files of given rows are added to a dataset by the store's own writer."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.normalize import normalized
from quillstone.plans.store import AssertionStore
from quillstone.sources.schema import GIVEN


def given_stream(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Parquet files of layout GIVEN as they arrive in a folder; ``options`` are those of the source."""
    return spark.readStream.schema(GIVEN).options(**options).parquet(folder)


def append_stream(given: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options: object) -> StreamingQuery:
    """Appends to the dataset at ``path`` (a store's own ``path``), one folder for each batch, numbered on from what any writer has added. The
    dataset knows a stream by its checkpoint, and the number of its last batch; so a batch that comes again, as after a failure between the write
    and the checkpoint, is left aside. ``options`` are those of the store (``vector_column``, ``keep_words``)."""
    folder, _, name = path.rpartition("/")
    stream = sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def append(rows: DataFrame, batch: int) -> None:
        AssertionStore(rows.sparkSession, folder, name=name, **options).add_frame(rows, stream=(stream, batch))

    writer = given.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(given: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by scope, predicate and window of the time in ``observed_at``; rows later than ``late`` behind the latest are left out.
    Rows whose time can't be read as one have no window."""
    timed = normalized(given).withColumn("observed_ts", F.try_to_timestamp("observed_at"))
    return timed.where("observed_ts IS NOT NULL").withWatermark("observed_ts", late).groupBy(F.window("observed_ts", window), "scope", "predicate").agg(F.count("*").alias("n_rows"))
