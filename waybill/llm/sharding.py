"""Shards of near equal bytes: longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import read, table

SHARDS = 40
#: Small groups are scheduled in this many bins; a group above a bin's mean size is scheduled by itself.
BINS = 10_000
#: Groups scheduled by themselves are numbered in lanes of about this many rows of all rows.
ROWS_A_LANE = 200_000
ROW_BYTES = 16


def schedule(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first, each to the least-loaded shard; ties go to the smaller name and the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, shards: int = SHARDS, bins: int = BINS, text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot. Size: UTF-8 bytes of the text plus 16.

    Rows of equal text go to one shard. Groups larger than total / ``bins`` are scheduled one by one: there are fewer than
    ``bins`` of them, whatever the input. The others are dealt by digest to ``bins`` bins, each of which is scheduled as a
    whole. So the heap sees at most 2 * ``bins`` sizes, and their placement is broadcast at that bound. Slots number a shard's
    rows without gaps: inside strata (a bin, or a lane of a large group), then over the strata's counts, so that no task holds a shard.

    Defined results: null texts are one group of size 16 each, with crc32 0; null doc_ids are ordered first; repeated rows
    are rows of their own; an empty table gives no rows; columns of ``docs`` named like a result are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot") and not c.startswith("_sh_")]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = (
        docs.select(*own)
        .withColumn("size", (F.octet_length(raw) + ROW_BYTES).cast("long"))
        .withColumn("text_crc32", F.crc32(raw))
        .withColumn("_sh_group", F.when(F.col(text).isNull(), "null").otherwise(F.md5(raw)))
    )
    bin_of = F.pmod(F.xxhash64("_sh_group"), F.lit(bins)).cast("string")
    groups = table(keyed.groupBy("_sh_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n_rows = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("n")).first())
    large = [(r.bytes, r._sh_group) for r in groups.where(F.col("bytes") * bins > total).collect()]
    small = [(r.bytes, r.bin) for r in groups.where(F.col("bytes") * bins <= total).groupBy(bin_of.alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()]
    placed = schedule(large + small, shards)
    units = spark.createDataFrame(list(placed.items()), "unit string, shard int")
    own_unit = spark.createDataFrame([(g,) for _, g in large], "_sh_big string")

    lanes = max(1, -(-n_rows // ROWS_A_LANE))
    lane = F.when(F.col("_sh_big").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(lanes))).otherwise(0).cast("int")
    rows = keyed.join(F.broadcast(own_unit), F.col("_sh_group") == F.col("_sh_big"), "left")
    rows = rows.withColumn("_sh_unit", F.coalesce("_sh_big", bin_of)).withColumn("_sh_lane", lane).drop("_sh_big")
    rows = rows.join(F.broadcast(units), F.col("_sh_unit") == F.col("unit")).drop("unit")
    strata = table(rows.groupBy("shard", "_sh_unit", "_sh_lane").agg(F.count("*").alias("_sh_n")))
    ahead = Window.partitionBy("shard").orderBy("_sh_unit", "_sh_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = strata.withColumn("_sh_ahead", F.coalesce(F.sum("_sh_n").over(ahead), F.lit(0))).drop("_sh_n")
    inside = Window.partitionBy("shard", "_sh_unit", "_sh_lane").orderBy("doc_id", "_sh_group")
    return (
        rows.withColumn("_sh_row", F.row_number().over(inside))
        .join(offsets, ["shard", "_sh_unit", "_sh_lane"])
        .select(*own, "size", "text_crc32", "shard", (F.col("_sh_ahead") + F.col("_sh_row") - 1).cast("long").alias("slot"))
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = assign(docs).drop("text")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
