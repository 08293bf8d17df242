"""Greedy choices in order, settled in rounds of joins: what a sequential pass would choose, without one task seeing all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators import rounds, shapes


def first_kept(rows: DataFrame, beats: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``id`` of the rows that a pass in order keeps when a kept row drops those it beats.

    ``rows`` have id; ``beats`` (better, worse) names pairs in which the better one comes earlier in the order, so there
    are no circles. A round keeps every open row that no open row beats and drops what these beat; each round settles at
    least the first open row of every chain.
    """
    rows, beats = rounds.settled(rows.select("id").distinct()), rounds.settled(beats.select("better", "worse").distinct())
    contested = beats.select(F.col("worse").alias("id")).distinct()
    kept = [rows.join(contested, "id", "left_anti")]
    dropped = rounds.settled(beats.join(kept[0].select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
    beats = rounds.settled(_open(beats, dropped, kept[0]))
    undecided = rounds.settled(contested.join(dropped, "id", "left_anti"))
    for _ in range(most_rounds):
        if undecided.isEmpty():
            break
        free = rounds.settled(undecided.join(beats.select(F.col("worse").alias("id")).distinct(), "id", "left_anti"))
        gone = rounds.settled(beats.join(free.select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        kept.append(free)
        beats = rounds.settled(_open(beats, gone, free))
        undecided = rounds.settled(undecided.join(free, "id", "left_anti").join(gone, "id", "left_anti"))
    else:
        raise RuntimeError(f"choices did not settle in {most_rounds} rounds")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _open(beats: DataFrame, gone: DataFrame, free: DataFrame) -> DataFrame:
    """The pairs between rows that are still undecided."""
    done = gone.unionByName(free)
    left = beats.join(done.select(F.col("id").alias("better")), "better", "left_anti")
    return left.join(done.select(F.col("id").alias("worse")), "worse", "left_anti").select("better", "worse")


def overlapping(sets: DataFrame, part: int, of: int) -> DataFrame:
    """(better, worse): rows of one group of which the worse, later in ``place``, has at least part / of its items in the better.

    ``sets`` are (group, id, place, items); items are distinct. If so many are shared, one of the first n - need + 1 is,
    in any order: the worse one looks its rarest items up, so pairs that share frequent items alone don't meet. Rows
    without items are worse than all before them if there are any.
    """
    own = rounds.settled(sets.select("group", "id", "place", F.array_distinct("items").alias("items")))
    item = own.select("group", "id", "place", F.explode("items").alias("item"))
    common = item.groupBy("group", "item").agg(F.count("*").alias("n"))
    ranked = item.join(common, ["group", "item"]).withColumn("nth", F.row_number().over(Window.partitionBy("group", "id").orderBy("n", "item")))
    size = F.size("items")
    need = F.ceil(size * F.lit(part) / F.lit(of))
    lead = ranked.join(own.select("group", "id", (size - need + 1).alias("_lead")), ["group", "id"]).where("nth <= _lead")
    met = lead.select("group", F.col("id").alias("worse"), F.col("place").alias("_w"), "item").join(item.select("group", F.col("id").alias("better"), F.col("place").alias("_b"), "item"), ["group", "item"])
    met = met.where("_b < _w").select("group", "better", "worse").distinct()
    items = own.select("group", "id", "items")
    a, b = items.select("group", F.col("id").alias("better"), F.col("items").alias("_b")), items.select("group", F.col("id").alias("worse"), F.col("items").alias("_w"))
    held = met.join(a, ["group", "better"]).join(b, ["group", "worse"]).where(F.size(F.array_intersect("_w", "_b")) * of >= F.size("_w") * part)
    least = own.groupBy("group").agg(F.min(F.struct("place", "id")).alias("f"))
    empty = own.where(size == 0).join(least, "group").where("place > f.place").select(F.col("f.id").alias("better"), F.col("id").alias("worse"))
    return held.select("better", "worse").unionByName(empty)


def without_overlap(sets: DataFrame, part: int = 4, of: int = 5, few: int = 2048) -> DataFrame:
    """The rows of ``sets`` (group, id, place, items and others) that stay when, group by group in the order of place, a row goes
    that shares part / of its items with one that stays. ``id`` and (group, place) are unique, items not null. With part = of it drops contained sets.

    Of equal sets of a group all but the first go, whether that one stays or not. A group whose other sets hold ``few`` items at most
    is then a row of its own and folded in order; in larger ones each set is such a row, and they are settled in rounds of joins.
    What is written is what stays of the former and the sets of the latter, so rows that come by group are not dealt again.
    """
    nth = F.row_number().over(Window.partitionBy("group", F.sort_array(F.array_distinct("items"))).orderBy("place"))
    held = F.sum(F.size("items") + 1).over(Window.partitionBy("group"))
    firsts = sets.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("_many", held > few)
    row = F.struct("place", *[c for c in sets.columns if c not in ("group", "place")])
    lists = firsts.groupBy("group", "_many", F.when(F.col("_many"), F.col("place")).alias("_alone")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    goes = lambda kept, x: F.exists(kept, lambda k: F.size(F.array_intersect(x["items"], k["items"])) * of >= F.size(F.array_distinct(x["items"])) * part)
    stay = F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.slice("_rows", 1, 1), lambda kept, x: F.when(goes(kept, x), kept).otherwise(F.array_append(kept, x)))
    found = rounds.settled(lists.select("group", "_many", F.inline(stay)).select(*sets.columns, "_many"))
    out, many = (found.where(c).select(*sets.columns) for c in ("not _many", "_many"))
    return out if many.isEmpty() else out.unionByName(many.join(first_kept(many, overlapping(many, part, of)), "id", "left_semi").select(*sets.columns))


def pairs_near(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """(left, right, distance) of points of ``a`` and ``b`` (id, x, y) at most ``limit`` apart; they meet in cells of that size."""
    cell = lambda v: F.floor(v / limit)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select(F.col("id").alias("left"), F.col("x").alias("_x"), F.col("y").alias("_y"), near.alias("d")).withColumn("cx", cell(F.col("_x")) + F.col("d.i")).withColumn("cy", cell(F.col("_y")) + F.col("d.j")).drop("d")
    right = b.select(F.col("id").alias("right"), "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    distance = F.sqrt((F.col("_x") - F.col("x")) * (F.col("_x") - F.col("x")) + (F.col("_y") - F.col("y")) * (F.col("_y") - F.col("y")))
    return left.join(right, ["cx", "cy"]).withColumn("distance", distance).where(F.col("distance") <= limit).select("left", "right", "distance")


def one_to_one(pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """The pairs (left, right, distance) that a pass in the order of (distance, left, right) takes when each side is taken once.

    A round takes the pairs that are the first of both their sides, as the pass would, and drops all others of these sides.
    """
    open_, taken = rounds.settled(pairs.select("left", "right", "distance")), []
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        order = F.struct("distance", "left", "right")
        best = open_.groupBy("left").agg(F.min(order).alias("p")).select("p.*")
        first = open_.groupBy("right").agg(F.min(order).alias("p")).select("p.left", "p.right")
        both = rounds.settled(best.join(first, ["left", "right"], "left_semi"))
        taken.append(both)
        open_ = rounds.settled(open_.join(both.select("left"), "left", "left_anti").join(both.select("right"), "right", "left_anti").select("left", "right", "distance"))
    else:
        raise RuntimeError(f"pairs did not settle in {most_rounds} rounds")
    out = pairs.where("false").select("left", "right", "distance") if not taken else taken[0].select("left", "right", "distance")
    for more in taken[1:]:
        out = out.unionByName(more.select("left", "right", "distance"))
    return out


def plane(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def one_to_one_near(a: DataFrame, b: DataFrame, limit: float, crowd: int = 4) -> DataFrame:
    """``one_to_one`` of all pairs of ``a`` and ``b`` (id, x, y) at most ``limit`` apart, without making them all.

    The pass takes near pairs first: so those within a short reach are settled before any longer pair is made, and of points that
    are taken none is made. Points at one place pair up by rank, as the pass would. The reach begins where few points of
    both sides share a cell and goes on fourfold, among the points that are left.
    """
    same = Window.partitionBy("x", "y").orderBy("id")
    left, right = (rounds.settled(df.select("id", "x", "y").where(shapes.finite("x", "y")).withColumn("_k", F.row_number().over(same))) for df in (a, b))
    taken = [rounds.settled(left.withColumnRenamed("id", "left").join(right.withColumnRenamed("id", "right"), ["x", "y", "_k"]).select("left", "right", F.lit(0.0).alias("distance")))]
    level = None
    while True:
        left, right = (rounds.settled(df.join(taken[-1].select(F.col(side).alias("id")), "id", "left_anti").select("id", "x", "y")) for df, side in ((left, "left"), (right, "right")))
        if level == 0 or left.isEmpty() or right.isEmpty():
            break
        level = shapes.fine_level(left, right, limit, crowd) if level is None else max(level - 2, 0)
        taken.append(rounds.settled(one_to_one(rounds.settled(pairs_near(left, right, limit / 2**level)))))
    return reduce(DataFrame.unionByName, taken)


def nearest_once_near(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """``nearest_once`` of all pairs of ``a`` and ``b`` (id, x, y) at most ``limit`` apart, of which only each left's nearest is made."""
    found = shapes.nearest(a, b, "id", "id", "x", "y", limit, plane, one_table=False)
    return nearest_once(found.select(F.col("id").alias("left"), F.col("other").alias("right"), "distance"))


def nearest_once(pairs: DataFrame) -> DataFrame:
    """Each left's nearest right (of equal ones the smallest) proposes; each right takes its nearest proposal. Who loses stays alone."""
    proposal = pairs.groupBy("left").agg(F.min(F.struct("distance", "right")).alias("p")).select("left", "p.right", "p.distance")
    return proposal.groupBy("right").agg(F.min(F.struct("distance", "left")).alias("p")).select("p.left", "right", "p.distance")
