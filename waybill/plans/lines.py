"""Lines and their periods, directions, components and names; occurrences; points along paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import geo, intervals, text
from waybill.operators import periods, relations
from waybill.plans.places import POINTS_SQL, points
from waybill.plans.registry import query

CALL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def calls(t):
    """Calls of journeys in order: (journey, pos, passes, flag, ...)."""
    w = Window.partitionBy("l_orderkey").orderBy(*CALL.split(", "))
    return t.lineitem.withColumn("pos", F.row_number().over(w))


@query(f"""
WITH c AS (SELECT l_orderkey, row_number() OVER w AS pos, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 4 <> 0 END AS flag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {CALL})),
e AS (SELECT l_orderkey, pos, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING)
  AND first_value(flag IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS ridden FROM c),
s AS (SELECT *, lead(ridden) OVER (PARTITION BY l_orderkey ORDER BY pos) AS nxt FROM e)
SELECT l_orderkey, pos, ridden AND nxt AS ridden FROM s WHERE nxt IS NOT NULL
""")
def q_ridden_segments(t):
    """A segment is ridden if both its ends are; a pass-through is as the stops around it both are."""
    own = calls(t).select("l_orderkey", "pos", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 4 != 0).alias("flag"))
    w = Window.partitionBy("l_orderkey").orderBy("pos")
    before = F.last("flag", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("flag", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("ridden", F.coalesce(before & after, F.lit(False))).withColumn("nxt", F.lead("ridden").over(w))
    return own.where("nxt is not null").select("l_orderkey", "pos", (F.col("ridden") & F.col("nxt")).alias("ridden"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderpriority AS status, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE + 90 END AS u FROM orders),
f AS (SELECT o_custkey, arg_min(status, (s, o_orderkey)) AS status FROM p WHERE s <= DATE '1996-06-01' AND (u IS NULL OR DATE '1996-06-01' < u) GROUP BY 1)
SELECT c_custkey, coalesce(f.status, CASE WHEN m.o_custkey IS NOT NULL THEN 'managed' ELSE 'unmanaged' END) AS status
FROM customer LEFT JOIN f ON c_custkey = f.o_custkey LEFT JOIN (SELECT DISTINCT o_custkey FROM p) m ON c_custkey = m.o_custkey
""")
def q_service_status(t):
    """The first period that covers the day; else whether there are periods at all."""
    day, start = F.lit("1996-06-01").cast("date"), F.to_date("o_orderdate")
    until = F.when(F.col("o_orderkey") % 9 != 0, F.date_add(start, 90))
    covers = intervals.in_force(day, start, until)
    known = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.when(covers, F.struct(start, "o_orderkey"))).alias("status"))
    own = t.customer.join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    return own.select("c_custkey", F.coalesce("status", F.when(F.col("o_custkey").isNotNull(), "managed").otherwise("unmanaged")).alias("status"))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 7)) AS k FROM lineitem GROUP BY 1)
SELECT array_to_string(k, '-') AS route, min(l_orderkey) AS first, count(*) AS n FROM s GROUP BY 1
""")
def q_seen_trips(t):
    """One trip for each set of places, whatever their order: the one with the least id."""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey") % 7)), "-").alias("route"))
    return sets.groupBy("route").agg(F.min("l_orderkey").alias("first"), F.count("*").alias("n"))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'relocatedNew' WHEN 2 THEN 'historical' ELSE 'relocatedOld' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS f,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + 700 END AS u FROM orders)
SELECT o_orderkey, kind, kind IN ('current', 'relocatedNew') AND (f IS NULL OR f <= DATE '1997-01-01') AND (u IS NULL OR DATE '1997-01-01' < u) AS shown FROM x
""")
def q_era_visible(t):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    kind = F.when(key % 4 == 0, "current").when(key % 4 == 1, "relocatedNew").when(key % 4 == 2, "historical").otherwise("relocatedOld")
    inside = intervals.in_force(F.lit("1997-01-01").cast("date"), F.when(key % 3 != 0, day), F.when(key % 5 != 0, F.date_add(day, 700)))
    return t.orders.select("o_orderkey", kind.alias("kind"), (kind.isin("current", "relocatedNew") & inside).alias("shown"))


@query(f"""
WITH p AS ({POINTS_SQL}), b AS (SELECT label, vec_id // 20 AS part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1, 2)
SELECT label, part, NOT (x1 < -0.1 OR 0.1 < x0 OR y1 < -0.1 OR 0.1 < y0) AS meets FROM b
""")
def q_box_meets(t):
    boxes = points(t).groupBy("label", F.floor(F.col("vec_id") / 20).alias("part")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    meets = (F.col("x1") >= -0.1) & (F.lit(0.1) >= F.col("x0")) & (F.col("y1") >= -0.1) & (F.lit(0.1) >= F.col("y0"))
    return boxes.select("label", "part", meets.alias("meets"))


@query("""
WITH r AS (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 50 END) AS histories, count(DISTINCT CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 13 > 6 THEN o_orderkey % 13 END) AS rest FROM orders GROUP BY 1)
SELECT o_custkey, (histories + rest)::BIGINT AS n FROM r
""")
def q_historical_line_count(t):
    """Distinct history ids, and distinct names of rides without one that no current line (0 to 6) has."""
    old = F.col("o_orderstatus") == "F"
    named = t.orders.where(~old).select("o_custkey", (F.col("o_orderkey") % 13).alias("name"))
    current = t.spark.range(7).withColumnRenamed("id", "name")
    rest = named.join(F.broadcast(current), "name", "left_anti").distinct().groupBy("o_custkey").agg(F.count("*").alias("rest"))
    own = t.orders.groupBy("o_custkey").agg(F.count_distinct(F.when(old, F.col("o_orderkey") % 50)).alias("histories"))
    return own.join(rest, "o_custkey", "left").select("o_custkey", (F.col("histories") + F.coalesce("rest", F.lit(0))).alias("n"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_suppkey % 5 AS line, round(l_extendedprice, 2) AS km, l_suppkey - lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {CALL}) AS d FROM lineitem),
v AS (SELECT l_orderkey, sum(CASE WHEN d > 0 THEN km ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN km ELSE 0 END) AS down FROM s WHERE d <> 0 GROUP BY 1),
l AS (SELECT l_orderkey, d > 0 AS is_up, line, sum(km) AS km FROM s WHERE d <> 0 GROUP BY 1, 2, 3),
b AS (SELECT l_orderkey, is_up, arg_min(line, (-round(km, 2), line)) AS line FROM l GROUP BY 1, 2)
SELECT v.l_orderkey, CASE WHEN up > down THEN 'up' ELSE 'down' END AS direction, line, round(greatest(up, down), 2) AS km
FROM v JOIN b ON v.l_orderkey = b.l_orderkey AND b.is_up = (up > down) WHERE round(up, 2) <> round(down, 2) AND greatest(up, down) / (up + down) >= 0.6
""")
def q_weighted_direction(t):
    """Up or down by the kilometres of a journey's steps, if three fifths agree, with the line that gave most of them."""
    w = Window.partitionBy("l_orderkey").orderBy(*CALL.split(", "))
    step = F.col("l_suppkey") - F.lag("l_suppkey").over(w)
    own = t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 5).alias("line"), F.round("l_extendedprice", 2).alias("km"), step.alias("d")).where("d <> 0")
    by = own.groupBy("l_orderkey", "line", (F.col("d") > 0).alias("is_up")).agg(F.sum("km").alias("km"))
    of = lambda up: F.when(F.col("is_up") == up, F.col("km"))
    best = lambda up: F.min_by("line", F.when(F.col("is_up") == up, F.struct(-F.round("km", 2), "line")))
    v = by.groupBy("l_orderkey").agg(F.coalesce(F.sum(of(True)), F.lit(0.0)).alias("up"), F.coalesce(F.sum(of(False)), F.lit(0.0)).alias("down"), best(True).alias("lu"), best(False).alias("ld"))
    up = F.col("up") > F.col("down")
    v = v.where((F.round("up", 2) != F.round("down", 2)) & (F.greatest("up", "down") / (F.col("up") + F.col("down")) >= 0.6))
    return v.select("l_orderkey", F.when(up, "up").otherwise("down").alias("direction"), F.when(up, F.col("lu")).otherwise(F.col("ld")).alias("line"), F.round(F.greatest("up", "down"), 2).alias("km"))


@query(f"""
WITH p AS (SELECT vec_id, label * 1000 + vec_id % 16 AS name, x / 100 AS x, y / 100 AS y FROM ({POINTS_SQL})),
d AS (SELECT a.name, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) AS m FROM p a JOIN p b ON a.name = b.name AND a.vec_id < b.vec_id)
SELECT p.name, count(*) AS n, round(coalesce(any_value(s), 0), 2) AS spread, coalesce(any_value(s), 0) > 300 AS collides FROM p LEFT JOIN (SELECT name, max(m) AS s FROM d GROUP BY 1) d ON p.name = d.name GROUP BY 1
""")
def q_name_spread(t):
    """Places of one name: the largest distance between two of them, and whether it is over 300 m.

    A place that no corner of its name's box is as far from as two of the outermost places are from each other can't be
    one of the farthest two, so only places near the box's border are paired.
    """
    own = points(t).select("vec_id", (F.col("label") * 1000 + F.col("vec_id") % 16).alias("name"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))
    n = own.groupBy("name").agg(F.count("*").alias("n"))
    point = F.struct("x", "y")
    box = own.groupBy("name").agg(
        *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))), *(f(point, c).alias(f"p{c}{k}") for c in "xy" for k, f in enumerate((F.min_by, F.max_by)))
    )
    apart = lambda p, q: geo.haversine_m(F.col(f"{p}.x"), F.col(f"{p}.y"), F.col(f"{q}.x"), F.col(f"{q}.y"))
    least = F.greatest(apart("px0", "px1"), apart("py0", "py1"))
    most = F.greatest(*(geo.haversine_m(F.col("x"), F.col("y"), F.col(f"x{i}"), F.col(f"y{j}")) for i in (0, 1) for j in (0, 1)))
    ends = own.join(box, "name").where(most * 1.001 >= least * 0.999).select("name", "vec_id", "x", "y")
    a, b = ends.alias("a"), ends.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    far = pairs.groupBy("a.name").agg(F.max(geo.haversine_m(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))).alias("s"))
    spread = F.coalesce("s", F.lit(0.0))
    return n.join(far, "name", "left").select("name", "n", F.round(spread, 2).alias("spread"), (spread > 300).alias("collides"))


@query("""
SELECT event_id, ((epoch(timezone('Asia/Tokyo', timezone('UTC', ts))) - epoch(timezone('America/New_York', timezone('UTC', ts)))) / 60)::INT AS shift,
  CASE WHEN value IS NULL THEN NULL WHEN event_id % 3 = 0 THEN round(value, 3) ELSE round(value - (epoch(timezone('Asia/Tokyo', timezone('UTC', ts))) - epoch(timezone('America/New_York', timezone('UTC', ts)))) / 60, 3) END AS minutes FROM events
""")
def q_zone_duration(t):
    """A duration between clocks of two zones, less the difference of their offsets on the day; within one zone as it is."""
    wall = lambda zone: F.unix_seconds(F.from_utc_timestamp("ts", zone))
    shift = ((wall("Asia/Tokyo") - wall("America/New_York")) / 60).cast("int")
    minutes = F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(F.col("value") - shift)
    return t.events.select("event_id", shift.alias("shift"), F.round(minutes, 3).alias("minutes"))


@query("""
WITH s AS (SELECT l_orderkey, row_number() OVER w AS pos, l_linenumber, l_shipdate::DATE AS day, min(l_shipdate::DATE) OVER (PARTITION BY l_orderkey) AS d0, sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) OVER w AS breaks FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
x AS (SELECT *, lead(breaks) OVER (PARTITION BY l_orderkey ORDER BY pos) AS far FROM s)
SELECT l_orderkey, pos, strftime(d0 + far::INT, '%Y-%m-%d') AS day FROM x WHERE far IS NOT NULL
""")
def q_segment_date(t):
    """The day of a segment is its far end's: the first day, and a day for each break up to there."""
    w = Window.partitionBy("l_orderkey").orderBy(*CALL.split(", "))
    own = t.lineitem.select(
        "l_orderkey", F.row_number().over(w).alias("pos"), F.min(F.to_date("l_shipdate")).over(Window.partitionBy("l_orderkey")).alias("d0"), F.sum(F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("breaks")
    )
    far = F.lead("breaks").over(Window.partitionBy("l_orderkey").orderBy("pos"))
    return own.withColumn("far", far).where("far is not null").select("l_orderkey", "pos", F.date_format(F.date_add("d0", F.col("far").cast("int")), "yyyy-MM-dd").alias("day"))


@query("""
WITH h AS (SELECT user_id, ts AS t0, lead(ts) OVER w AS t1, sum(value) OVER w AS s1, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT user_id, min(ts) + INTERVAL 36 HOUR AS q, max(ts) AS last, sum(value) AS total FROM events GROUP BY 1)
SELECT q.user_id, round(CASE WHEN q.q >= q.last THEN q.total ELSE h.s1 - h.value + h.value * (epoch(q.q) - epoch(h.t0)) / (epoch(h.t1) - epoch(h.t0)) END, 4) AS distance
FROM q LEFT JOIN h ON q.user_id = h.user_id AND h.t0 <= q.q AND q.q < h.t1
""")
def q_playback(t):
    """How far each user is 36 hours after the first event: linear between events, the whole way after the last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hops = t.events.select("user_id", F.col("ts").alias("t0"), F.lead("ts").over(w).alias("t1"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s1"), "value")
    every = Window.partitionBy("user_id")
    hops = hops.withColumn("q", F.min("t0").over(every) + F.expr("interval 36 hours")).withColumn("total", F.sum("value").over(every))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = (at("q") - at("t0")) / (at("t1") - at("t0"))
    inside = (F.col("t0") <= F.col("q")) & (F.col("q") < F.col("t1"))
    return hops.groupBy("user_id").agg(F.round(F.coalesce(F.max(F.when(inside, F.col("s1") - F.col("value") + F.col("value") * part)), F.first("total")), 4).alias("distance"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, start::BIGINT AS start, least(n, start + 4)::BIGINT AS stop FROM (SELECT l_orderkey, n, unnest(CASE WHEN n > 4 THEN range(0, n - 1, 3) ELSE [0] END) AS start FROM n WHERE n >= 2)
""")
def q_chunk_ranges(t):
    """Ranges of at most three segments that overlap by one vertex; a path of fewer than two vertices has none."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 2")
    zero = F.lit(0).cast("long")
    starts = F.when(F.col("n") > 4, F.sequence(zero, F.col("n") - 2, F.lit(3).cast("long"))).otherwise(F.array(zero))
    return n.select("l_orderkey", "n", F.explode(starts).alias("start")).select("l_orderkey", "start", F.least(F.col("n"), F.col("start") + 4).alias("stop"))


@query(f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT label, vec_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (SELECT *, ceil(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / 0.05)::BIGINT AS k FROM s WHERE bx IS NOT NULL),
e AS (SELECT label, vec_id, ax, ay, bx, by_, k, unnest(range(1, greatest(k, 1) + 1)) AS i FROM m)
SELECT label, vec_id, i::BIGINT AS i, round(ax + (bx - ax) * i / greatest(k, 1), 7) AS x, round(ay + (by_ - ay) * i / greatest(k, 1), 7) AS y FROM e WHERE k > 0
""")
def q_densify(t):
    """Points at most 0.05 apart along each path; a segment without length adds none."""
    w = Window.partitionBy("label").orderBy("vec_id")
    s = points(t).select("label", "vec_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    k = F.ceil(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)) / 0.05)
    e = s.withColumn("k", k).where("k > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("i"))
    on = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("k"), 7)
    return e.select("label", "vec_id", "i", on("ax", "bx").alias("x"), on("ay", "by").alias("y"))


@query(f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT label, vec_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT label, vec_id, ax, ay, bx, by_, i, unnest(range(floor(least(ay, by_) / 0.1)::BIGINT, floor(greatest(ay, by_) / 0.1)::BIGINT + 1)) AS j
  FROM (SELECT *, unnest(range(floor(least(ax, bx) / 0.1)::BIGINT, floor(greatest(ax, bx) / 0.1)::BIGINT + 1)) AS i FROM s WHERE bx IS NOT NULL)),
x AS (SELECT *, (bx - ax) * (j * 0.1 - ay) - (by_ - ay) * (i * 0.1 - ax) AS c0, (by_ - ay) * 0.1 AS dx, (bx - ax) * 0.1 AS dy FROM c)
SELECT label, vec_id, i::BIGINT AS i, j::BIGINT AS j FROM x WHERE NOT (least(c0, c0 - dx, c0 + dy, c0 - dx + dy) > 0 OR greatest(c0, c0 - dx, c0 + dy, c0 - dx + dy) < 0)
""")
def q_cells_crossed(t):
    """Cells of 0.1 that a segment touches: those of its box whose corners don't all lie on one side of it."""
    w = Window.partitionBy("label").orderBy("vec_id")
    s = points(t).select("label", "vec_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b) / 0.1), F.floor(F.greatest(a, b) / 0.1))
    c = s.select("*", F.explode(cells("ax", "bx")).alias("i")).select("*", F.explode(cells("ay", "by")).alias("j"))
    c0 = (F.col("bx") - F.col("ax")) * (F.col("j") * 0.1 - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("i") * 0.1 - F.col("ax"))
    dx, dy = (F.col("by") - F.col("ay")) * 0.1, (F.col("bx") - F.col("ax")) * 0.1
    corners = [c0, c0 - dx, c0 + dy, c0 - dx + dy]
    return c.where(~((F.least(*corners) > 0) | (F.greatest(*corners) < 0))).select("label", "vec_id", "i", "j")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, -1 - (((epoch(o_orderdate) // 86400)::BIGINT * 5 + substr(o_orderpriority, 1, 1)::BIGINT - 1) * 1000 + floor(o_totalprice / 5000)::BIGINT) AS b FROM orders),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS there FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.there = u.a)
SELECT node, min(there) AS component FROM r GROUP BY 1
""")
def q_line_components(t):
    """Customers and the kinds of orders (day, priority, price class) that link them."""
    kind = (F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400) * 5 + F.substring("o_orderpriority", 1, 1).cast("long") - 1) * 1000 + F.floor(F.col("o_totalprice") / 5000)
    return relations.components(t.orders.select(F.col("o_custkey").alias("a"), (F.lit(-1) - kind).alias("b")))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 60 AS a, lead(l_suppkey % 60) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b, l_shipdate::DATE AS day FROM lineitem),
t AS (SELECT DISTINCT p_partkey % 60 AS a, p_size AS b FROM part)
SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 'sameLine' WHEN t.a IS NOT NULL THEN 'throughService' ELSE 'none' END AS link, p.a = p.b AS allowed, count(*) AS n FROM p LEFT JOIN t ON p.a = t.a AND p.b = t.b WHERE p.b IS NOT NULL GROUP BY 1, 2, 3, 4
""")
def q_link_kind(t):
    """Same line, through service or none; only the same line gives physical permission."""
    w = Window.partitionBy("l_orderkey").orderBy(*CALL.split(", "))
    pairs = t.lineitem.select((F.col("l_suppkey") % 60).alias("a"), F.lead(F.col("l_suppkey") % 60).over(w).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    through = t.part.select((F.col("p_partkey") % 60).alias("a"), F.col("p_size").cast("long").alias("b")).distinct().withColumn("_t", F.lit(True))
    link = F.when(F.col("a") == F.col("b"), "sameLine").when(F.col("_t"), "throughService").otherwise("none")
    return pairs.join(through, ["a", "b"], "left").select("a", "b", link.alias("link"), (F.col("a") == F.col("b")).alias("allowed"), "n")


@query("""
WITH p AS (SELECT o_orderkey AS id, o_custkey AS line, o_orderdate::DATE AS f, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate::DATE - 3 ELSE o_orderdate::DATE + 40 END AS u FROM orders),
x AS (SELECT *, max(CASE WHEN f < u THEN u END) OVER (PARTITION BY line ORDER BY f, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p)
SELECT id, CASE WHEN f >= u THEN 'interval' ELSE 'overlap' END AS finding FROM x WHERE f >= u OR m > f
""")
def q_status_findings(t):
    """Periods that end before they begin, and those that begin inside an earlier one of their line."""
    f = F.to_date("o_orderdate")
    own = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line"), f.alias("f"), F.when(F.col("o_orderkey") % 6 == 0, F.date_sub(f, 3)).otherwise(F.date_add(f, 40)).alias("u"))
    before = Window.partitionBy("line").orderBy("f", "id").rowsBetween(Window.unboundedPreceding, -1)
    empty = F.col("f") >= F.col("u")
    own = own.withColumn("m", F.max(F.when(~empty, F.col("u"))).over(before))
    return own.where(empty | (F.col("m") > F.col("f"))).select("id", F.when(empty, "interval").otherwise("overlap").alias("finding"))


@query("""
SELECT o_orderkey, o_orderkey % 3 = 1 AND o_orderpriority = '1-URGENT' AND (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate::DATE END) AS usable FROM orders
""")
def q_result_gate(t):
    """A precomputed result is used only if version, digest and date are the expected ones; two missing dates are equal."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    same = F.when(key % 4 != 0, day).eqNullSafe(F.when(key % 8 != 0, day))
    return t.orders.select("o_orderkey", ((key % 3 == 1) & (F.col("o_orderpriority") == "1-URGENT") & same).alias("usable"))


@query("""
WITH n AS (SELECT DISTINCT s_name AS name, s_suppkey AS id FROM supplier), c AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Supplier#' || lpad((o_orderkey % 20)::VARCHAR, 9, '0') WHEN 1 THEN ' Supplier#' || lpad((o_orderkey % 30)::VARCHAR, 9, '0') || '/nobody／Supplier#' || lpad((o_orderkey % 7)::VARCHAR, 9, '0') ELSE '' END AS name FROM orders),
w AS (SELECT k, trim(name) AS name FROM c), p AS (SELECT k, name, unnest(string_split(replace(name, '／', '/'), '/')) AS part, unnest(range(len(string_split(replace(name, '／', '/'), '/')))) AS i FROM w),
g AS (SELECT p.k, n.id, min(p.i) AS i FROM p JOIN n ON p.part = n.name WHERE p.name LIKE '%/%' OR p.name LIKE '%／%' GROUP BY 1, 2)
SELECT w.k, coalesce(e.id::VARCHAR, string_agg(g.id::VARCHAR, ',' ORDER BY g.i), '') AS ids FROM w LEFT JOIN n e ON w.name = e.name LEFT JOIN g ON w.k = g.k GROUP BY w.k, e.id
""")
def q_catalog_operators(t):
    """Operator ids of a catalog name: the whole name's, else those of its parts in order, without repeats and unknown ones."""
    key = F.col("o_orderkey")
    sup = lambda n: F.concat(F.lit("Supplier#"), F.lpad((key % n).cast("string"), 9, "0"))
    name = F.when(key % 3 == 0, sup(20)).when(key % 3 == 1, F.concat(F.lit(" "), sup(30), F.lit("/nobody／"), sup(7))).otherwise("")
    own = t.orders.select(key.alias("k"), F.trim(name).alias("name"))
    ids = t.supplier.select(F.col("s_name").alias("part"), F.col("s_suppkey").alias("id")).distinct()
    tries = F.when(F.col("name").rlike("[/／]"), F.split("name", "[/／]")).otherwise(F.array().cast("array<string>"))
    parts = own.select("k", F.posexplode(F.concat(F.array("name"), tries)).alias("i", "part")).join(ids, "part").groupBy("k", "id").agg(F.min("i").alias("i"))
    found = parts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("f"))
    whole = F.get("f.i", F.lit(0)) == 0
    joined = own.join(found, "k", "left")
    return joined.select("k", F.coalesce(F.when(whole, F.get("f.id", F.lit(0)).cast("string")).otherwise(F.array_join("f.id", ",")), F.lit("")).alias("ids"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '線' WHEN 1 THEN p_name || '線' ELSE p_name END AS line, concat(lower(p_brand), '-', 'JP') AS resource FROM part
""")
def q_line_names(t):
    """Canonical line names (trimmed, NFKC, a trailing 本線 is 線), and resource names with a country's suffix."""
    key = F.col("p_partkey") % 3
    raw = F.concat(F.lit(" "), "p_name", F.when(key == 0, "本線 ").when(key == 1, "線").otherwise(""))
    return t.part.select("p_partkey", text.line_name(raw).alias("line"), F.concat(F.lower("p_brand"), F.lit("-JP")).alias("resource"))


@query("""
WITH c AS (SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_suppkey AS platform FROM lineitem),
d AS (SELECT o_orderkey AS trip, unnest([o_orderdate::DATE, o_orderdate::DATE + 7]) AS day FROM orders)
SELECT d.trip::VARCHAR || '@' || strftime(d.day, '%Y-%m-%d') AS occurrence_id, c.seq::BIGINT AS stop_sequence, CASE WHEN (d.trip + c.seq) % 14 = 0 THEN NULL WHEN (d.trip + c.seq) % 7 = 0 THEN -1 ELSE c.platform END AS platform FROM d JOIN c ON c.trip = d.trip
""")
def q_occurrences(t):
    """Calls of each trip and day, keyed trip@day; a day's overrides replace a platform or clear it."""
    w = Window.partitionBy("trip_id").orderBy(*CALL.split(", "))
    lines = t.lineitem.withColumn("trip_id", F.col("l_orderkey"))
    own = lines.select("trip_id", F.row_number().over(w).cast("long").alias("stop_sequence"), F.col("l_suppkey").alias("platform"))
    days = t.orders.select(F.col("o_orderkey").alias("trip_id"), F.explode(F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 7))).alias("service_date"))
    mark = F.col("trip_id") + F.col("stop_sequence")
    clear = mark % 14 == 0
    overrides = days.join(own, "trip_id").where(mark % 7 == 0).select("trip_id", "service_date", "stop_sequence", F.when(~clear, F.lit(-1).cast("long")).alias("platform"), clear.cast("int").alias("platform_present"))
    return periods.occurrences(days, own, overrides, ["platform"]).select("occurrence_id", "stop_sequence", "platform")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '?' ELSE p_brand END AS expected, p_brand || '!' AS new FROM part WHERE p_partkey % 3 = 0)
SELECT part.p_partkey, CASE WHEN p.expected = part.p_brand THEN p.new ELSE part.p_brand END AS p_brand, p.expected = part.p_brand IS TRUE AS patched FROM part LEFT JOIN p USING (p_partkey)
""")
def q_guarded_patch(t):
    """A patch applies only where the value is the one it expects."""
    base = t.part.select("p_partkey", "p_brand")
    key = F.col("p_partkey")
    patches = base.where(key % 3 == 0).select("p_partkey", F.when(key % 5 == 0, F.concat("p_brand", F.lit("?"))).otherwise(F.col("p_brand")).alias("expected"), F.concat("p_brand", F.lit("!")).alias("new"))
    done, _ = relations.apply_patches(base, patches, "p_partkey", "p_brand")
    return done.select("p_partkey", "p_brand", F.col("p_brand").endswith("!").alias("patched"))
