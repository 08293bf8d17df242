"""Streams that append batch by batch and can be stopped at any point, recovery of pending writes, and results of superseded jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, path: str, checkpoint: str, progress: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends what has arrived of ``stream`` to the table at ``path``, a folder for each micro-batch, and ends.

    A batch that is run again, because the query stopped between its write and its commit, has the same number and replaces
    its folder, so nothing is there twice; the checkpoint says where to go on. ``progress`` is called after each batch's
    write. ``path`` and ``checkpoint`` are folders that the driver and all executors share.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if progress:
            progress(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of batches that were written, without their batch's number; no folder gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def replayed(store: DataFrame, pending: DataFrame) -> DataFrame:
    """``store`` (key, body) after the pending writes (key, at, client, base, body) that fit: (key, body, applied, conflict).

    Writes of a key are taken in the order of (at, client). One fits if its base is the body that the store has by then, both
    missing for a new key; one whose body is there already is done. The first that does neither stops its key: ``conflict``
    holds its body beside the store's, and later ones wait. A key's pending writes are all that one row holds.
    """
    writes = F.array_sort(F.collect_list(F.struct("at", "client", "base", F.col("body").alias("new"))))
    both = store.select("key", "body", F.lit(True).alias("there")).join(pending.groupBy("key").agg(writes.alias("writes")), "key", "full")
    none = F.lit(None).cast("string")

    def step(state: Column, w: Column) -> Column:
        done = state["body"].eqNullSafe(w["new"])
        fits = state["body"].eqNullSafe(w["base"])
        stopped = state["stopped"] | ~(done | fits)
        return F.struct(
            F.when(stopped, state["body"]).otherwise(w["new"]).alias("body"),
            (state["applied"] + (~stopped & ~done).cast("int")).alias("applied"),
            F.when(stopped & ~state["stopped"], w["new"]).otherwise(state["conflict"]).alias("conflict"),
            stopped.alias("stopped"),
        )

    start = F.struct(F.col("body").alias("body"), F.lit(0).alias("applied"), none.alias("conflict"), F.lit(False).alias("stopped"))
    end = F.aggregate(F.coalesce("writes", F.array().cast("array<struct<at:timestamp,client:string,base:string,new:string>>")), start, step)
    return both.select("key", end.alias("e")).select("key", "e.body", "e.applied", "e.conflict").where("body is not null or conflict is not null")


# ---------------------------------------------------------------- jobs that supersede each other


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _files(spark, path)
    return fs.exists(at)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, at, _ = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def begin(spark: SparkSession, path: str) -> int:
    """A token for a new job on the result at ``path``: larger than all before it, which it supersedes. Two jobs never get the same."""
    fs, at, hadoop = _files(spark, f"{path}/jobs")
    fs.mkdirs(at)
    token = (_numbers(spark, f"{path}/jobs", "") or [0])[-1] + 1
    while not fs.createNewFile(hadoop.Path(f"{path}/jobs/{token}")):
        token += 1
    return token


def publish(result: DataFrame, path: str, token: int) -> bool:
    """Writes ``result`` as the job's, unless a later job has begun by then, before or after the write: then it is refused and False returned."""
    spark = result.sparkSession
    later = lambda: _numbers(spark, f"{path}/jobs", "")[-1] > token
    if later():
        return False
    result.write.mode("overwrite").parquet(f"{path}/open={token}")
    if later():
        return False
    fs, at, hadoop = _files(spark, f"{path}/open={token}")
    return bool(fs.rename(at, hadoop.Path(f"{path}/result={token}")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The published result of the latest job that has one."""
    done = _numbers(spark, path, "result=")
    return spark.read.parquet(f"{path}/result={done[-1]}") if done else None
