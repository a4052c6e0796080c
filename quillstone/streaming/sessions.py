"""Access events as they arrive: each counts once however often it is delivered, and the events of a trace that follow each other closely are a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.traces import ACCESS


def access_stream(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Parquet files of layout ACCESS as they arrive in a folder."""
    return spark.readStream.schema(ACCESS).options(**options).parquet(folder)


def access_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``trace_id``, ``access_kind``, ``first``, ``last`` (as text), ``n_events`` and ``n_assertions`` (about) of each session: events no further apart than
    ``gap``. Of deliveries of one ``event_id`` that are no more than ``late`` behind the latest time the first one counts; events whose time can't be read, or
    that come later, are left out. A session of a stream is given once, when nothing more can belong to it."""
    timed = events.withColumn("at", F.try_to_timestamp("observed_at")).where("at IS NOT NULL").withWatermark("at", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])
    counted = once.groupBy(F.session_window("at", gap), "trace_id", "access_kind").agg(
        F.count("*").alias("n_events"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.approx_count_distinct("assertion_id").alias("n_assertions")
    )
    return counted.select("trace_id", "access_kind", "first", "last", "n_events", "n_assertions")
