"""Tables between the rounds of an iteration, on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. On one machine (master local[...]) a temporary one stands in where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="waybill-")
        shared_folder.own = found
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: a round's plan ends there, and a lost executor costs one read."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 500_000, count: int | None = None) -> DataFrame:
    """``df`` by keys in as many partitions as its rows, or ``count``, call for, so that what a task holds does not grow with the input."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-(df.count() if count is None else count) // rows)), *keys)
