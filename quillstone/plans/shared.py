"""Intermediate results in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir. Where that is unset a local session gets a temporary one, and a cluster an error, as its
    executors can't see the driver's disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A Parquet table in the shared folder, read again, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def place_of(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    place, files = place_of(spark, path)
    files.delete(place, True)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves a table to a place that is free."""
    place, files = place_of(spark, old)
    target, _ = place_of(spark, new)
    if files.exists(target) or not files.rename(place, target):
        raise OSError(f"{old} could not be moved to {new}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if there is no such folder."""
    place, files = place_of(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def made_folder(spark: SparkSession, path: str) -> None:
    """An empty folder, with those above it."""
    place, files = place_of(spark, path)
    files.mkdirs(place)
