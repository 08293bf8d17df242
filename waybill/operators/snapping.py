"""Vertices snapped to the first one in their neighbourhood, as a pass in order would, without one task seeing all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import geo
from waybill.operators import rounds

_EAST, _NORTH = geo.KM_A_DEGREE_EAST * 1000, geo.KM_A_DEGREE_NORTH * 1000
_SIDE = 0.999 / 2**0.5


def snapped(points: DataFrame, lon: str, lat: str, order: str, tolerance_m: float, most_rounds: int = 500) -> DataFrame:
    """``points`` with ``rep``: the smallest ``order`` of a representative in tolerance, where a pass in order makes a vertex one
    if none that came before is in tolerance. ``order`` is unique and not null; a vertex without coordinates has no rep.

    Cells are so small that any two vertices of one are in tolerance, so each holds one representative at most. A round
    tries the first open vertex of each cell: it becomes one if no earlier open vertex is in tolerance, and closes those
    in its own. Each vertex meets one candidate in each of 25 cells, however crowded they are; equal coordinates are one
    vertex from the start. Rounds follow the longest chain of vertices that wait for each other. Latitudes lie within 89
    degrees, and the line of 180 degrees is a border.
    """
    if tolerance_m <= 0:
        return points.withColumn("rep", F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.col(order)))
    row = F.floor(F.col("y") * _NORTH / (tolerance_m * _SIDE))
    places = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(F.col(lon).alias("x"), F.col(lat).alias("y")).agg(F.min(order).alias("at"))
    places = rounds.settled(places.withColumn("row", row).withColumn("col", _column(F.col("x"), F.col("row"), tolerance_m)))
    open_, leaders = places, []
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("row", "col").agg(F.min_by(F.struct("x", "y", "at"), "at").alias("f")).select("row", "col", "f.*")
        tried = rounds.settled(first)
        waits = _met(tried, open_, tolerance_m, later="l").where("l_at > at").select(F.col("l_at").alias("at")).distinct()
        new = rounds.settled(tried.join(waits, "at", "left_anti").select("x", "y", "at", "row"))
        closed = _met(new, open_, tolerance_m, later="o").where("l_at <= at").select("at").distinct()
        leaders.append(new)
        open_ = rounds.settled(open_.join(closed, "at", "left_anti"))
    else:
        raise RuntimeError(f"vertices did not settle in {most_rounds} rounds")
    if not leaders:
        return points.withColumn("rep", F.when(F.lit(False), F.col(order)))
    every = leaders[0]
    for more in leaders[1:]:
        every = every.unionByName(more)
    reps = _met(every, places, tolerance_m, later="o").where("l_at <= at").groupBy("x", "y").agg(F.min("l_at").alias("rep"))
    return points.join(reps.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "rep"), (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y")), "left").drop("_x", "_y")


def _column(x: Column, row: Column, tolerance_m: float) -> Column:
    """The cell of a longitude in a row; the row's least distance to the equator sets its width."""
    edge = F.when(row >= 0, row).otherwise(row + 1) * (tolerance_m * _SIDE / _NORTH)
    return F.floor(x * _EAST * F.cos(F.radians(edge)) / (tolerance_m * _SIDE))


def _met(few: DataFrame, many: DataFrame, tolerance_m: float, later: str) -> DataFrame:
    """``many`` with the rows l_x, l_y, l_at of ``few`` in tolerance. The scale is that of the later vertex: l is few's, o many's."""
    near = few.select(F.col("x").alias("l_x"), F.col("y").alias("l_y"), F.col("at").alias("l_at"), F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)).alias("row"))
    middle = _column(F.col("l_x"), F.col("row"), tolerance_m)
    near = near.withColumn("col", F.explode(F.sequence(middle - 2, middle + 2)))
    scale = F.cos(F.radians("l_y" if later == "l" else "y")) * _EAST
    east, north = (F.col("x") - F.col("l_x")) * scale, (F.col("y") - F.col("l_y")) * _NORTH
    return many.join(near, ["row", "col"]).where(east * east + north * north <= tolerance_m * tolerance_m)
