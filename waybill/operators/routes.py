"""Routes over lines: several best paths between many pairs through ordered anchors, and best paths with free changes of line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators import graph, rounds


def line_edges(calls: DataFrame, line: str, order: list, place: str, metres: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """(line, a, b, m): directed steps between consecutive places of a line, the shortest of repeated ones; ``metres`` of two values."""
    w = Window.partitionBy(line).orderBy(*order)
    step = calls.select(F.col(line).alias("line"), F.col(place).alias("a"), F.lead(place).over(w).alias("b"), metres(F.col(value), F.lead(value).over(w)).alias("m"))
    return step.where("a is not null and b is not null and a <> b and m >= 0").groupBy("line", "a", "b").agg(F.min("m").alias("m"))


def k_best(
    edges: DataFrame, requests: DataFrame, hops: int, k: int = 3, labels: int = 8, may_change: Callable[[Column, Column, Column], Column] | None = None
) -> DataFrame:
    """(request, rank, m, transfers, hops, nodes, lines, pruned): up to ``k`` paths of each request, the best first.

    ``edges`` are (line, a, b, m); ``requests`` (request, anchors): at least two different places, to be met in this order.
    A path visits no place twice, has ``hops`` steps at most, ends where it meets its last anchor after all others, and
    changes from one line to another at a place only where ``may_change`` (line, to_line, at) holds. Paths are ordered by
    metres, changes, steps, then by their places and lines.

    A round extends all paths of all requests by a step: a join with the edges, never with a copy of them on the driver.
    Of paths at one place on one line, with equal steps and anchors met, ``labels`` go on; steps that can't reach the last
    anchor within the bound are dropped before, by a search backward from the last anchors. ``pruned`` says that some
    path of the request did not go on: without it the result is that of a full enumeration within the bound of steps.
    """
    edges = rounds.settled(edges.select("line", "a", "b", "m"))
    requests = rounds.settled(requests.where("size(anchors) >= 2").select("request", "anchors", F.element_at("anchors", -1).alias("last")))
    backward = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    need = rounds.settled(graph.reachable(backward, requests.select(F.col("last").alias("node")).distinct(), hops - 1).select(F.col("start").alias("last"), F.col("node").alias("b"), F.col("hops").alias("need")))
    node, line = edges.schema["a"].dataType, edges.schema["line"].dataType
    frontier = requests.select(
        "*", F.get("anchors", F.lit(0)).cast(node).alias("node"), F.lit(None).cast(line).alias("on"), F.lit(0).alias("met"), F.lit(0).cast("long").alias("m"), F.lit(0).alias("transfers"),
        F.array(F.get("anchors", F.lit(0)).cast(node)).alias("nodes"), F.array().cast(f"array<{line.simpleString()}>").alias("lines"),
    )
    e = edges.select(F.col("line").alias("_line"), F.col("a").alias("node"), "b", F.col("m").alias("_m"))
    changes = F.coalesce(F.col("on") != F.col("_line"), F.lit(False))
    ends, cut = [], []
    order = [F.col("m"), F.col("transfers"), F.col("nodes"), F.col("lines")]
    for h in range(1, hops + 1):
        step = frontier.join(e, "node").where(~F.array_contains("nodes", F.col("b")))
        if may_change is not None:
            step = step.where(~changes | may_change(F.col("on"), F.col("_line"), F.col("node")))
        met = F.col("met") + (F.get("anchors", F.col("met") + 1) == F.col("b")).cast("int")
        step = step.withColumn("met", met).withColumn("arrived", F.col("met") == F.size("anchors") - 1)
        step = step.where(F.col("arrived") | (F.col("b") != F.col("last"))).join(need.where(F.col("need") <= hops - h), ["last", "b"])
        step = step.select(
            "request", "anchors", "last", F.col("b").alias("node"), F.col("_line").alias("on"), "met", (F.col("m") + F.col("_m")).alias("m"), (F.col("transfers") + changes.cast("int")).alias("transfers"),
            F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("lines", F.col("_line")).alias("lines"), "arrived",
        )
        at = Window.partitionBy("request", "node", "on", "met").orderBy(*order)
        layer = rounds.settled(step.withColumn("_nth", F.row_number().over(at)))
        cut.append(layer.where(F.col("_nth") > labels).select("request").distinct())
        ends.append(layer.where("arrived").select("request", "m", "transfers", F.lit(h).alias("hops"), "nodes", "lines"))
        frontier = layer.where(~F.col("arrived") & (F.col("_nth") <= labels)).drop("arrived", "_nth")
    found, pruned = ends[0], cut[0]
    for a, b in zip(ends[1:], cut[1:]):
        found, pruned = found.unionByName(a), pruned.union(b)
    best = Window.partitionBy("request").orderBy("m", "transfers", "hops", "nodes", "lines")
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kept = kept.join(pruned.distinct().withColumn("pruned", F.lit(True)), "request", "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))
    return kept.select("request", "rank", "m", "transfers", "hops", "nodes", "lines", "pruned")


def with_changes(edges: DataFrame, starts: DataFrame, rides: int) -> DataFrame:
    """(start, node, m, transfers, stops): the best way from each start to each place with at most ``rides`` steps.

    ``edges`` are (line, a, b, m), ``starts`` have ``node``. Changing lines at a place costs no metres but counts: of equal
    metres the fewest changes win, then the first stops. States are places on lines; a change goes through the place
    itself, so a place of n lines costs n rows, not pairs of lines. A round joins what the last one improved with the
    edges; rounds end when nothing improves. ``stops`` are the places of the way from start to node.
    """
    edges = rounds.settled(edges.select("line", "a", "b", "m"))
    boards = rounds.settled(edges.select(F.col("a").alias("node"), "line").distinct())
    label = F.struct("m", "transfers", "stops").alias("l")
    own = starts.select("node").distinct().join(boards, "node")
    best = rounds.settled(own.select(F.col("node").alias("start"), "node", "line", F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).alias("transfers"), F.array("node").alias("stops")).alias("l")))
    frontier = best
    for _ in range(rides):
        rode = frontier.select("start", F.col("node").alias("a"), "line", "l.*").join(edges.select("line", "a", "b", F.col("m").alias("_m")), ["a", "line"])
        rode = rode.select("start", F.col("b").alias("node"), "line", (F.col("m") + F.col("_m")).alias("m"), "transfers", F.array_append("stops", F.col("b")).alias("stops"))
        rode = rounds.settled(rode.groupBy("start", "node", "line").agg(F.min(label).alias("l")))
        here = rode.groupBy("start", "node").agg(F.min("l").alias("l"))
        changed = here.join(boards, "node").select("start", "node", "line", F.struct(F.col("l.m").alias("m"), (F.col("l.transfers") + 1).alias("transfers"), F.col("l.stops").alias("stops")).alias("l"))
        new = rode.unionByName(changed.select(*rode.columns)).groupBy("start", "node", "line").agg(F.min("l").alias("new"))
        both = best.join(new, ["start", "node", "line"], "full").withColumn("better", F.col("l").isNull() | (F.col("new") < F.col("l")))
        both = rounds.settled(both.select("start", "node", "line", F.when(F.coalesce("better", F.lit(False)), F.col("new")).otherwise(F.col("l")).alias("l"), F.coalesce("better", F.lit(False)).alias("better")))
        best, frontier = both.drop("better"), both.where("better").drop("better")
        if frontier.isEmpty():
            break
    return best.groupBy("start", "node").agg(F.min("l").alias("l")).select("start", "node", "l.*")
