"""Ordered calls and events: runs, repeats, measures, day breaks, votes. Windows are partitioned by journey or user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """(keys, run, value, n, first, last): stretches of equal consecutive values, numbered from 1; first and last by order[0]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    numbered = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def in_order(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values as an array in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda x: x["_v"]).alias(name))


def without_repeats(items: Column) -> Column:
    """An array without items equal to the one before; later returns stay."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def measures(df: DataFrame, keys: list[str], order: list, km: str) -> DataFrame:
    """The row's start and end along its journey."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(km).over(w), F.lit(0.0))
    return df.withColumn("start_m", start).withColumn("end_m", F.col("start_m") + F.col(km))


def occurrence_codes(df: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """``a:b`` where the pair comes once, ``a:b~n`` for its n-th of several."""
    pair = Window.partitionBy(a, b)
    code = F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    nth = F.row_number().over(pair.orderBy(*order))
    return df.withColumn("code", F.when(F.count("*").over(pair) > 1, F.concat(code, F.lit("~"), nth.cast("string"))).otherwise(code))


def day_breaks(df: DataFrame, keys: list[str], order: list, minutes: str) -> DataFrame:
    """``day`` so far of each call and whether it begins one: a break needs an earlier timed call on a smaller day."""
    w = Window.partitionBy(*keys).orderBy(*order)
    day = F.floor(F.col(minutes) / 1440)
    before = F.max(day).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("day", F.greatest(day, before)).withColumn("breaks", F.coalesce(day > before, F.lit(False)))


def carried(df: DataFrame, keys: list[str], order: list, minutes: str) -> DataFrame:
    """``df`` with ``carried``: the clock with a day added for each step back so far; rows without a clock have none and are passed over."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(minutes, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = F.coalesce((F.col(minutes) < before).cast("int"), F.lit(0))
    days = F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_back", back).withColumn("carried", F.col(minutes) + 1440 * days).drop("_back")


def votes(df: DataFrame, keys: list[str], journey: str, order: list, place: str, least: int, share: float) -> DataFrame:
    """The direction that most steps of each key take, where enough journeys vote and enough steps agree."""
    w = Window.partitionBy(*keys, journey).orderBy(*order)
    step = F.signum(F.col(place) - F.lag(place).over(w))
    by = df.withColumn("_s", step).where("_s <> 0").groupBy(*keys).agg(
        F.count_distinct(journey).alias("journeys"), F.sum(F.when(F.col("_s") > 0, 1).otherwise(0)).alias("up"), F.count("*").alias("steps")
    )
    up = F.col("up") >= F.col("steps") - F.col("up")
    agree = F.greatest(F.col("up"), F.col("steps") - F.col("up")) / F.col("steps")
    return by.where((F.col("journeys") >= least) & (agree >= share)).withColumn("direction", F.when(up, "up").otherwise("down"))


def unique_window(df: DataFrame, keys: list[str], at: str, kind: str, start: str, end: str) -> DataFrame:
    """(keys, start_at, end_at) where exactly one pair of a start and a later end is; else nulls.

    Pairs are counted with a running count of starts, not listed.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_start, is_end = F.col(kind) == start, F.col(kind) == end
    seen = df.withColumn("_starts", F.count(F.when(is_start, 1)).over(w)).withColumn("_start", F.min(F.when(is_start, F.col(at))).over(w))
    by = seen.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(is_end, F.col("_starts"))), F.lit(0)).alias("pairs"),
        F.min(F.when(is_end & (F.col("_starts") > 0), F.struct(F.col(at), F.col("_start")))).alias("one"),
    )
    only = F.col("pairs") == 1
    return by.select(*keys, "pairs", F.when(only, F.col("one._start")).alias("start_at"), F.when(only, F.col(f"one.{at}")).alias("end_at"))


def run_lengths(items: Column) -> Column:
    """An array as structs of value and n for its runs of equal items."""
    n = F.size(items)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | ~F.get(items, i).eqNullSafe(F.get(items, i - 1)))
    return F.zip_with(starts, F.array_append(F.slice(starts, 2, n), n), lambda a, b: F.struct(F.get(items, a).alias("value"), (b - a).alias("n")))


def expanded(lengths: Column) -> Column:
    """What ``run_lengths`` was made from."""
    return F.flatten(F.transform(lengths, lambda r: F.array_repeat(r["value"], r["n"])))
