"""Bounded searches over networks as frontier joins: a round is a join with the edges and a pruning aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators import rounds


def edges_of_calls(df: DataFrame, journey: str, order: list, place: str, km: str) -> DataFrame:
    """(a, b, km): the least km between consecutive places of journeys, in both directions."""
    w = Window.partitionBy(journey).orderBy(*order)
    step = df.withColumn("_b", F.lead(place).over(w)).where(F.col("_b").isNotNull() & (F.col("_b") != F.col(place)))
    both = F.array(F.struct(F.col(place).alias("a"), F.col("_b").alias("b")), F.struct(F.col("_b").alias("a"), F.col(place).alias("b")))
    return step.select(F.inline(both), F.col(km).alias("km")).groupBy("a", "b").agg(F.min("km").alias("km"))


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): the fewest hops to each node, up to a bound. Only nodes new in a round go on."""
    edges = rounds.settled(edges)
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    frontier = found
    for k in range(1, hops + 1):
        step = frontier.join(edges.select(F.col("a").alias("node"), F.col("b").alias("to")), "node").select("start", F.col("to").alias("node")).distinct()
        frontier = step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(k))
        frontier = rounds.settled(frontier)
        found = found.unionByName(frontier)
    return found


def shortest(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, km, hops, truncated): the least km within a bound of hops; of equals the fewest hops.

    A label that a round does not improve is dropped before the next. ``truncated`` says that the last round still
    improved the node, so more hops might as well.
    """
    edges = rounds.settled(edges)
    best = starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("km"), F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        e = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("km").alias("_km"))
        step = best.where(F.col("hops") == k - 1).join(e, "node").groupBy("start", F.col("to").alias("node")).agg(F.min(F.col("km") + F.col("_km")).alias("km"))
        both = best.unionByName(step.withColumn("hops", F.lit(k)))
        best = both.groupBy("start", "node").agg(F.min(F.struct("km", "hops")).alias("m")).select("start", "node", "m.km", "m.hops")
        best = rounds.settled(best)
    return best.withColumn("truncated", F.col("hops") == hops)


def best_legs(legs: list[DataFrame], most: int) -> DataFrame:
    """The best sums of one choice a leg (id, km), keeping so many after each leg: no prefix that is not among them can win."""
    out = legs[0].select(F.array("id").alias("ids"), "km").orderBy("km", "ids").limit(most)
    for leg in legs[1:]:
        # both sides are at most ``most`` rows: a worse choice of a leg cannot be in a best sum
        few = F.broadcast(leg.select(F.col("id").alias("_i"), F.col("km").alias("_k")).orderBy("_k", "_i").limit(most))
        out = out.crossJoin(few).select(F.array_append("ids", F.col("_i")).alias("ids"), (F.col("km") + F.col("_k")).alias("km")).orderBy("km", "ids").limit(most)
    return out
