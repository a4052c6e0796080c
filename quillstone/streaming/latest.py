"""The last row of each key, kept up by a stream.

The state of a key is its last row by (observed_at, ingest_seq); rows that come late, in any order, change nothing if a later one was seen. What each
trigger changes is written to a folder of its own, which a repeated trigger writes again; readers take the last of what all have written. Of the rows
of a trigger each task passes on the last of each key only, so the state is asked once for a key and task at most, and only such rows become JSON.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillstone.plans.extensions import KEY, latest

#: Keys that a task holds.
HELD = 50_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRow(StatefulProcessor):
    """Holds and returns the last row of a key as JSON, and its time and number to compare by."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "observed_at string, ingest_seq long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r["observed_at"], r["ingest_seq"]), default=None)
        held = self.last.get()
        if best is not None and (held is None or (best["observed_at"], best["ingest_seq"]) > tuple(held)):
            self.last.update((best["observed_at"], best["ingest_seq"]))
            yield Row(row=best["row"])

    def close(self) -> None:
        pass


def last_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each key (key, observed_at, ingest_seq, ...), of every HELD keys or more."""
    held = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        own = (own if held is None else pa.concat_tables([held, own])).combine_chunks()
        own = own.take(pc.sort_indices(own, [("observed_at", "descending"), ("ingest_seq", "descending")]))
        place = pa.table({"key": own["key"], "place": np.arange(len(own))})
        held = own.take(place.group_by("key").aggregate([("place", "min")])["place_min"])
        if len(held) > HELD:
            yield from held.combine_chunks().to_batches()
            held = None
    if held is not None:
        yield from held.combine_chunks().to_batches()


def latest_stream(rows: DataFrame, path: str, checkpoint: str, key: Sequence[str] = KEY, ttl_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Keeps the last row of each key of a stream of stored rows at ``path``. With ``ttl_ms`` a key that has not changed for so long is forgotten, and
    what comes for it then is taken for its last row, which readers still compare with what was written before."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    slim = rows.select(F.to_json(F.struct(*key)).alias("key"), "observed_at", "ingest_seq", F.struct("*").alias("row"))
    slim = slim.mapInArrow(last_of_task, slim.schema).withColumn("row", F.to_json("row"))
    mode = "processingTime" if ttl_ms else "none"
    changed = slim.groupBy("key").transformWithState(LastRow(ttl_ms), "row string", "Update", mode)
    schema = rows.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.select(F.from_json("row", schema).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/trigger={n}")

    writer = changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_rows(spark: SparkSession, path: str, key: Sequence[str] = KEY) -> DataFrame:
    """The last row of each key, of what the stream has written."""
    return latest(spark.read.parquet(path).drop("trigger"), key)
