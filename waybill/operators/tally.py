"""Counts, rankings and summaries of journeys. Each groups once, with partial sums before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], km: Column, digits: int = 2) -> DataFrame:
    """Rides and km by key, in places: most rides, then most km, then the smallest key."""
    by = df.groupBy(*keys).agg(F.count("*").alias("rides"), F.round(F.sum(km), digits).alias("km"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rides"), F.desc("km"), *keys)))


def zero_filled(df: DataFrame, part: Column, low: int, high: int) -> DataFrame:
    """(value, rides) for each value from low to high, 0 where none is."""
    counts = df.groupBy(part.cast("long").alias("value")).agg(F.count("*").alias("rides"))
    every = df.sparkSession.range(low, high + 1, numPartitions=1).select(F.col("id").alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("rides", F.lit(0)).alias("rides"))


def extremes(df: DataFrame, key: str, id_: str, km: str) -> DataFrame:
    """Longest and shortest by key; of equals the smallest id."""
    return df.groupBy(key).agg(
        F.max_by(id_, F.struct(F.col(km), -F.col(id_))).alias("longest_id"),
        F.max(km).alias("longest"),
        F.min_by(id_, F.struct(F.col(km), F.col(id_))).alias("shortest_id"),
        F.min(km).alias("shortest"),
    )


def dominant(df: DataFrame, keys: list[str], value: str, km: str, digits: int = 2) -> DataFrame:
    """The value with most km by key; of equals the smallest."""
    by = df.groupBy(*keys, value).agg(F.round(F.sum(km), digits).alias("_km"))
    best = F.min(F.struct((-F.col("_km")).alias("less"), F.col(value).alias("value"), F.col("_km").alias("km")))
    return by.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.value").alias(value), F.col("best.km").alias(km))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value by key, of equals the smallest, and how many there are."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.col(value).alias("value")))
    return by.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("variants")).select(*keys, F.col("best.value").alias("modal"), "variants")


def steps(value: Column, floors: list[tuple[float, int]], rest: int) -> Column:
    """The step of the first floor, highest first, that the value reaches."""
    out = F.lit(rest)
    for floor, step in sorted(floors):
        out = F.when(value >= floor, step).otherwise(out)
    return out


def means_of_known(df: DataFrame, keys: list[str], value: Column, known: Column, digits: int = 4) -> DataFrame:
    """Rows, known rows, the mean over known ones, and the total of all: the unknown count in the total but not the mean."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rides"),
        F.count(F.when(known, 1)).alias("timed"),
        F.round(F.avg(F.when(known, value)), digits).alias("mean_known"),
        F.round(F.sum(value), 2).alias("total"),
    )


def inferred(df: DataFrame, tiers: list[tuple[str, list[str], DataFrame]], value: str) -> DataFrame:
    """``df`` with ``value``, the most frequent one of the first tier (name, keys, known rows) that knows its keys, and the tier's name as ``source``."""
    out = df
    for i, (_, keys, known) in enumerate(tiers):
        out = out.join(modal(known.where(F.col(value).isNotNull()), keys, value).select(*keys, F.col("modal").alias(f"_v{i}")), keys, "left")
    found = [F.col(f"_v{i}") for i in range(len(tiers))]
    source = F.coalesce(*[F.when(v.isNotNull(), name) for v, (name, _, _) in zip(found, tiers)])
    return out.select(*df.columns, F.coalesce(*found).alias(value), source.alias("source"))
