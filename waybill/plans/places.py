"""Names, search, shapes and networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import geo, masks, text
from waybill.operators import graph, quality, search, sequences, shapes
from waybill.plans.registry import query


@query("""SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key, count(DISTINCT p_type) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def q_homonyms(t):
    return search.homonyms(t.part.select("p_brand", "p_type"), text.fold_ascii(F.col("p_brand")), "p_type")


@query("""
SELECT p_partkey, p_name, rank, row_number() OVER (ORDER BY rank, p_name, p_partkey) AS place FROM (
  SELECT p_partkey, p_name, CASE WHEN p_name = 'blue anchor' THEN 0 WHEN p_name LIKE 'blue%' THEN 1 WHEN p_name LIKE '%blue%' THEN 2 WHEN p_type LIKE '%BRASS%' THEN 3 END AS rank FROM part)
WHERE rank IS NOT NULL QUALIFY place <= 50
""")
def q_search_rank(t):
    name = F.col("p_name")
    rank = F.when(name == "blue anchor", 0).otherwise(text.rank(name, "blue", F.regexp_replace("p_type", "BRASS", "blue")))
    return search.best(t.part.select("p_partkey", "p_name", "p_type"), rank, ["p_name", "p_partkey"], 50).select("p_partkey", "p_name", "rank", "place")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Alpha' ELSE 'b' END || '/' || p_brand AS label, CASE WHEN p_size % 2 = 0 THEN 'Alpha' ELSE '-' END AS prefix FROM part
""")
def q_company_label(t):
    joined = F.concat(F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"), F.lit("/ ／"), F.col("p_brand"), F.lit("/"))
    name = text.label(joined, {"a": "Alpha"})
    prefix = F.when(F.col("p_size") % 2 == 0, "Alpha").otherwise("b")
    shown = text.unless_leading(prefix, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(name))
    return t.part.select("p_partkey", name.alias("label"), F.coalesce(shown, F.lit("-")).alias("prefix"))


@query("""SELECT p_partkey, p_name AS name, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS size FROM part""")
def q_caption_split(t):
    whole = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))))
    name, brand, size = text.caption(whole)
    return t.part.select("p_partkey", name.alias("name"), brand.alias("brand"), size.alias("size"))


@query()
def q_fold(t):
    return t.documents.select("doc_id", F.length(text.search_key(F.col("text"))).alias("n_folded"), F.length(text.station_key(F.col("text"))).alias("n_key"))


@query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2""")
def q_facets(t):
    return search.facets(t.part.select("p_brand", "p_type"), ["p_brand", "p_type"])


@query("""SELECT regexp_extract(p_name, '([^ ]+)$', 1) AS core, count(DISTINCT p_name) AS names, count(*) AS n FROM part GROUP BY 1""")
def q_similar_core(t):
    core = F.regexp_extract("p_name", "([^ ]+)$", 1)
    return t.part.groupBy(core.alias("core")).agg(F.count_distinct("p_name").alias("names"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT CASE WHEN p_type LIKE '%BRASS%' THEN 'outside' WHEN p_size > 45 THEN 'unknown' ELSE p_brand END AS name, min(p_partkey) AS "first", count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1)
SELECT name, "first", n, row_number() OVER (ORDER BY "first") AS place FROM g
""")
def q_browse_groups(t):
    name = masks.first_rule([(F.col("p_type").contains("BRASS"), "outside"), (F.col("p_size") > 45, "unknown")])
    return search.first_seen_groups(t.part.where("p_size > 5"), F.coalesce(name, F.col("p_brand")), "p_partkey")


@query("""
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k <= 7 ORDER BY p_brand, k LIMIT 100
""")
def q_section_caps(t):
    return search.capped(t.part.select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), "p_partkey"], 7, 100).select("p_brand", "p_partkey")


@query("""
WITH n AS (SELECT p_partkey, p_type, CASE WHEN p_size = 50 THEN NULL WHEN p_size % 10 = 0 THEN 900 + p_size // 10 WHEN p_size % 10 = 1 THEN 100 + p_size // 10 WHEN p_size % 10 = 2 THEN 1400 WHEN p_size % 10 = 3 THEN 398 + p_size // 10 WHEN p_size % 10 = 4 THEN 12 WHEN p_size % 10 = 6 THEN 403 + p_size // 10 ELSE p_size % 10 END AS n FROM part)
SELECT p_partkey, coalesce(n IN (0, 1, 2, 5, 7, 12) OR n BETWEEN 100 AND 117 OR n BETWEEN 400 AND 405 OR n BETWEEN 900 AND 906 OR n = 1400, false) AS rail,
  CASE WHEN n = 0 OR n BETWEEN 900 AND 906 THEN 'tram' WHEN n = 1 OR n BETWEEN 400 AND 405 THEN 'metro' WHEN n = 2 OR n BETWEEN 100 AND 117 THEN 'rail' WHEN n = 5 THEN 'cable' WHEN n IN (7, 1400) THEN 'funicular' WHEN n = 12 THEN 'monorail' ELSE 'rail' END AS kind,
  CASE WHEN regexp_matches(p_type, '^(STANDARD|ECONOMY)') THEN 'local' WHEN regexp_matches(p_type, '^SM|MO$') THEN 'express' ELSE 'other' END AS service FROM n
""")
def q_route_type(t):
    size = F.col("p_size")
    code = (
        F.when(size == 50, "x").when(size % 10 == 0, F.concat(F.lit(" "), (900 + F.floor(size / 10)).cast("string"))).when(size % 10 == 1, (100 + F.floor(size / 10)).cast("string"))
        .when(size % 10 == 2, "1400").when(size % 10 == 3, (398 + F.floor(size / 10)).cast("string")).when(size % 10 == 4, "12").when(size % 10 == 6, (403 + F.floor(size / 10)).cast("string"))
        .otherwise((size % 10).cast("string"))
    )
    service = masks.first_rule([(F.col("p_type").rlike("^(STANDARD|ECONOMY)"), "local"), (F.col("p_type").rlike("^SM|MO$"), "express")], "other")
    return t.part.select("p_partkey", masks.is_rail_route(code).alias("rail"), masks.route_kind(code).alias("kind"), service.alias("service"))


@query("""
SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z]+|[0-9]+'), ' ') AS tokens,
  contains(lower(p_name), 'anchor') OR contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') OR contains(lower(p_type), 'anchor') AS hit FROM part
""")
def q_tokens(t):
    words = text.tokens(F.concat_ws(" ", "p_name", "p_brand"))
    fields = F.array_compact(F.array(F.lower("p_name"), F.lower("p_type")))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("tokens"), text.matches(fields, "anchor", {"anchor": ["bolt"]}).alias("hit"))


@query(r"""
WITH n AS (SELECT p_brand AS n FROM part UNION SELECT p_brand || ' ' || p_type FROM part WHERE p_size > 45),
w AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || 's (JP, ' || p_type || ')' WHEN 1 THEN p_brand || ' ' || p_type WHEN 2 THEN p_brand || '(' || p_type || ')' ELSE p_brand || ' ' || p_type || ' (TW, ' || p_name || ')' END AS whole FROM part)
SELECT p_partkey, arg_max(n, length(n)) AS name, regexp_extract(whole, '^(.*) \(([A-Z]{2}), ([^()]*)\)$', 2) AS cc, regexp_extract(whole, '^(.*) \(([A-Z]{2}), ([^()]*)\)$', 3) AS line
FROM w JOIN n ON whole = n OR starts_with(whole, n || ' ') OR starts_with(whole, n || '(') GROUP BY p_partkey, whole
""")
def q_prefix_match(t):
    """The longest name that leads a text, up to a blank, a bracket or the end; a name that goes on in the text is none."""
    brand, kind, key = F.col("p_brand"), F.col("p_type"), F.col("p_partkey") % 4
    whole = (
        F.when(key == 0, F.concat(brand, F.lit("s (JP, "), kind, F.lit(")"))).when(key == 1, F.concat(brand, F.lit(" "), kind)).when(key == 2, F.concat(brand, F.lit("("), kind, F.lit(")")))
        .otherwise(F.concat(brand, F.lit(" "), kind, F.lit(" (TW, "), F.col("p_name"), F.lit(")")))
    )
    own = t.part.select("p_partkey", whole.alias("whole"))
    names = t.part.select(brand.alias("name_")).union(t.part.where("p_size > 45").select(F.concat(brand, F.lit(" "), kind)))
    found = search.longest_prefix(own, "whole", names, "name_")
    _, cc, line = text.reference(F.col("whole"))
    return found.select("p_partkey", "name", cc.alias("cc"), line.alias("line"))


@query("""SELECT p_brand, arg_min(p_partkey, (-p_size, p_partkey)) AS winner, count(*) AS members FROM part GROUP BY 1""")
def q_election(t):
    return search.elected(t.part, "p_brand", [-F.col("p_size"), F.col("p_partkey")], "p_partkey")


@query("""SELECT p_partkey, 'Part ' || p_name || ' of ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '{brand}' END || ' {rest}' AS filled FROM part""")
def q_template(t):
    filled = text.fill(F.lit("Part {name} of {brand} {rest}"), {"name": F.col("p_name"), "brand": F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))})
    return t.part.select("p_partkey", filled.alias("filled"))


@query("""
WITH x AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat([0], x[1:len(x) - 1], [999]), ',') AS chain, CASE WHEN len(x) < 2 THEN 'short' WHEN x[1] = x[len(x)] THEN 'loop' ELSE '-' END AS error FROM x
""")
def q_seam_decode(t):
    own = sequences.in_order(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_suppkey", "x")
    chain = F.concat(F.array(F.lit(0).cast("long")), F.slice("x", 1, F.size("x") - 1), F.array(F.lit(999).cast("long")))
    error = quality.first_error([(F.size("x") < 2, "short"), (F.get("x", F.lit(0)) == F.element_at("x", -1), "loop")])
    return own.select("l_orderkey", F.array_join(chain, ",").alias("chain"), F.coalesce(error, F.lit("-")).alias("error"))


POINTS_SQL = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def points(t):
    return t.embeddings.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(f"""
WITH p AS ({POINTS_SQL}), q AS (SELECT vec_id, label, floor(x * 10 + 0.5) / 10 AS x, floor(y * 10 + 0.5) / 10 AS y FROM p),
s AS (SELECT x AS ax, y AS ay, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS bx, lead(y) OVER (PARTITION BY label ORDER BY vec_id) AS by_ FROM q)
SELECT CASE WHEN (ax, ay) < (bx, by_) THEN ax ELSE bx END AS x0, CASE WHEN (ax, ay) < (bx, by_) THEN ay ELSE by_ END AS y0, CASE WHEN (ax, ay) < (bx, by_) THEN bx ELSE ax END AS x1, CASE WHEN (ax, ay) < (bx, by_) THEN by_ ELSE ay END AS y1, count(*) AS n
FROM s WHERE bx IS NOT NULL GROUP BY 1, 2, 3, 4
""")
def q_quant_edges(t):
    own = points(t).select("label", "vec_id", geo.round_up_half(F.col("x"), 1).alias("x"), geo.round_up_half(F.col("y"), 1).alias("y"))
    s = shapes.segments(own, ["label"], "vec_id", "x", "y")
    a, b = geo.undirected(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    return s.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")).select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "n")


@query(f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
d AS (SELECT *, coalesce(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(y - py) / 2), 2) + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(x - px) / 2), 2)))), 0) AS m,
  coalesce(sqrt(pow((x - px) * 111.32 * cos(radians((py + y) / 2)), 2) + pow((y - py) * 110.574, 2)), 0) AS km FROM s)
SELECT vec_id, label, round(m, 3) AS step, round(sum(m) OVER (PARTITION BY label ORDER BY vec_id), 2) AS measure, round(km, 5) AS km FROM d
""")
def q_path_measure(t):
    own = shapes.path(points(t), ["label"], "vec_id", "x", "y", geo.haversine_m)
    w = Window.partitionBy("label").orderBy("vec_id")
    km = F.coalesce(geo.flat_km(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")), F.lit(0.0))
    return own.select("vec_id", "label", F.round("step", 3).alias("step"), F.round("measure", 2).alias("measure"), F.round(km, 5).alias("km"))


@query(f"""
WITH p AS ({POINTS_SQL}), d AS (SELECT a.vec_id, b.vec_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(other, (distance, other)) AS other, round(min(distance), 8) AS distance FROM d WHERE distance <= 0.2 GROUP BY 1
""")
def q_nearest_grid(t):
    own = points(t)
    return shapes.nearest(own, own, "vec_id", "vec_id", "x", "y", 0.2).select("vec_id", "other", F.round("distance", 8).alias("distance"))


@query()
def q_polyline_dp(t):
    """The points of each path that 55 km of tolerance leave. SQL has no such recursion; tests hold it against a plain one."""
    return shapes.simplified(points(t), ["label"], "vec_id", "x", "y", 55_000.0)


@query(f"""
WITH p AS ({POINTS_SQL}), c AS (SELECT label AS centre, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1),
d AS (SELECT centre, vec_id, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM p JOIN c ON label = centre) SELECT centre, arg_min(vec_id, (round(d, 9), vec_id)) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY 1
""")
def q_nearest_centroid(t):
    own = points(t)
    centres = shapes.boxes(own, ["label"], "x", "y").select(F.col("label").alias("centre"), "cx", "cy")
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    met = own.join(F.broadcast(centres), F.col("label") == F.col("centre")).withColumn("d", d)
    return met.groupBy("centre").agg(F.min_by("vec_id", F.struct(F.round("d", 9), F.col("vec_id"))).alias("nearest"), F.round(F.min("d"), 6).alias("distance"))


@query(f"""
WITH p AS ({POINTS_SQL}) SELECT label, count(*) AS n, round(sum(x), 4) AS total FROM p WHERE floor(x / 0.5) IN (-1, 0) AND floor(y / 0.5) IN (0, 1) GROUP BY 1
""")
def q_area_restrict(t):
    leaves = t.spark.createDataFrame([(i, j) for i in (-1, 0) for j in (0, 1)], "cx long, cy long")
    own = points(t).withColumn("cx", F.floor(F.col("x") / 0.5)).withColumn("cy", F.floor(F.col("y") / 0.5))
    return own.join(F.broadcast(leaves), ["cx", "cy"], "left_semi").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


SEGMENTS_SQL = f"SELECT * FROM (SELECT label, vec_id AS seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE bx IS NOT NULL"


@query(f"""
WITH s AS ({SEGMENTS_SQL}), t AS (SELECT *, greatest(0, least(1, ((0.1 - ax) * (bx - ax) + (0.2 - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM s),
d AS (SELECT label, seq, sqrt(pow(0.1 - (ax + t * (bx - ax)), 2) + pow(0.2 - (ay + t * (by_ - ay)), 2)) AS d,
  sqrt(pow(greatest(least(ax, bx) - 0.1, 0, 0.1 - greatest(ax, bx)), 2) + pow(greatest(least(ay, by_) - 0.2, 0, 0.2 - greatest(ay, by_)), 2)) AS low FROM t)
SELECT label, arg_min(seq, (round(d, 9), seq)) AS seq, round(min(d), 6) AS distance, bool_and(low <= d + 1e-9) AS bounded FROM d GROUP BY 1
""")
def q_segment_projection(t):
    s = shapes.segments(points(t), ["label"], "vec_id", "x", "y")
    px, py = F.lit(0.1), F.lit(0.2)
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    low = geo.box_distance(px, py, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    own = s.select("label", "seq", geo.segment_distance(px, py, *ends).alias("d"), low.alias("low"))
    return own.groupBy("label").agg(F.min_by("seq", F.struct(F.round("d", 9), F.col("seq"))).alias("seq"), F.round(F.min("d"), 6).alias("distance"), F.bool_and(F.col("low") <= F.col("d") + 1e-9).alias("bounded"))


@query(f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
d AS (SELECT label, vec_id, x, y, px, py, sum(coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0)) OVER (PARTITION BY label ORDER BY vec_id) AS m FROM s),
e AS (SELECT *, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS pm FROM d)
SELECT label, round(m, 6) AS measure, round(x, 6) AS x, round(y, 6) AS y FROM e WHERE m BETWEEN 3.0 AND 7.5
UNION ALL SELECT label, round(c, 6), round(px + (c - pm) / (m - pm) * (x - px), 6), round(py + (c - pm) / (m - pm) * (y - py), 6) FROM e, (VALUES (3.0::DOUBLE), (7.5::DOUBLE)) v(c) WHERE pm < c AND c < m
""")
def q_slice_measure(t):
    flat = lambda a, b, c, d: F.sqrt(F.pow(c - a, 2) + F.pow(d - b, 2))
    own = shapes.slice_between(shapes.path(points(t), ["label"], "vec_id", "x", "y", flat), ["label"], "x", "y", 7.5, 3.0)
    return own.select("label", *[F.round(c, 6).alias(c) for c in ("measure", "x", "y")])


@query(f"""
WITH p AS ({POINTS_SQL}) SELECT label, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(avg(y), 6) AS cy, bool_and(x BETWEEN -5 AND 5 AND y BETWEEN -5 AND 5) AS wholly, bool_or(x BETWEEN 0 AND 0.1 AND y BETWEEN 0 AND 0.1) AS partly FROM p GROUP BY 1
""")
def q_bbox(t):
    own = points(t)
    x, y = F.col("x"), F.col("y")
    within = own.groupBy("label").agg(F.bool_and(shapes.inside(x, y, -5, -5, 5, 5)).alias("wholly"), F.bool_or(shapes.inside(x, y, 0, 0, 0.1, 0.1)).alias("partly"))
    return shapes.boxes(own, ["label"], "x", "y").join(within, "label").select("label", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), F.round("cy", 6).alias("cy"), "wholly", "partly")


@query(f"""
WITH p AS ({POINTS_SQL}), d AS (SELECT label, min(sqrt(pow(x - 0.3, 2) + pow(y, 2))) AS d FROM p GROUP BY 1) SELECT label, round(d, 6) AS distance, row_number() OVER (ORDER BY round(d, 6), label) AS place FROM d WHERE d <= 0.25
""")
def q_hits(t):
    d = F.sqrt(F.pow(F.col("x") - 0.3, 2) + F.pow(F.col("y"), 2))
    own = points(t).where(shapes.inside(F.col("x"), F.col("y"), 0.05, -0.25, 0.55, 0.25)).groupBy("label").agg(F.min(d).alias("d")).where("d <= 0.25")
    return own.select("label", F.round("d", 6).alias("distance")).withColumn("place", F.row_number().over(Window.orderBy("distance", "label")))


NETWORK_SQL = """
WITH RECURSIVE c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS km, s_nationkey * 4 + (l_partkey % 4)::INT AS p, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT p AS a, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, km) AS b, km FROM c),
e AS (SELECT a, b, min(km) AS km FROM (SELECT a, b, km FROM s WHERE b IS NOT NULL AND a <> b UNION ALL SELECT b, a, km FROM s WHERE b IS NOT NULL AND a <> b) GROUP BY 1, 2)
"""


def network(t):
    own = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    place = (F.col("s_nationkey") * 4 + (F.col("l_partkey") % 4).cast("int")).alias("p")
    calls = own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("km"), place)
    return graph.edges_of_calls(calls, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "km"], "p", "km")


def start(t, *nodes):
    return t.spark.createDataFrame([(n,) for n in nodes], "node int")


@query(NETWORK_SQL + "SELECT a, b, round(km, 2) AS km FROM e")
def q_graph_edges(t):
    return network(t).select("a", "b", F.round("km", 2).alias("km"))


@query(NETWORK_SQL + """, r AS (SELECT 0 AS node, 0 AS hops UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON r.node = e.a WHERE r.hops < 3) SELECT 0 AS start, node, min(hops) AS hops FROM r GROUP BY 2""")
def q_reachable(t):
    return graph.reachable(network(t), start(t, 0), 3)


@query(NETWORK_SQL + """, r AS (SELECT 0 AS node, 0.0::DOUBLE AS km, 0 AS hops UNION ALL SELECT node, min(km), h FROM (SELECT e.b AS node, r.km + e.km AS km, r.hops + 1 AS h FROM r JOIN e ON r.node = e.a WHERE r.hops < 4) GROUP BY node, h)
SELECT 0 AS start, node, round(min(km), 2) AS km FROM r GROUP BY 2""")
def q_shortest_path(t):
    return graph.shortest(network(t), start(t, 0), 4).select("start", "node", F.round("km", 2).alias("km"))


@query("""
WITH a AS (SELECT l_orderkey AS id, round(min(l_extendedprice), 2) AS km FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_orderkey AS id, round(min(l_extendedprice), 2) AS km FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
a5 AS (SELECT * FROM a ORDER BY km, id LIMIT 5), b5 AS (SELECT * FROM b ORDER BY km, id LIMIT 5)
SELECT concat(a5.id, '>', b5.id) AS ids, round(a5.km + b5.km, 2) AS km FROM a5, b5 ORDER BY a5.km + b5.km, a5.id, b5.id LIMIT 5
""")
def q_topk_legs(t):
    leg = lambda k: t.lineitem.where(F.col("l_linenumber") == k).groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.min("l_extendedprice"), 2).alias("km"))
    return graph.best_legs([leg(1), leg(2)], 5).select(F.array_join("ids", ">").alias("ids"), F.round("km", 2).alias("km"))


_ASKED = ("000000003", "build 1-urgent", "1996-01")


@query("""
WITH j AS (SELECT o_orderkey, r_name, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day, regexp_replace(lower(o_orderpriority || ' ' || c_mktsegment), '[^a-z0-9]+', '', 'g') AS f, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS g
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT unnest(['000000003', 'build 1-urgent', '1996-01']) AS query), w AS (SELECT query, regexp_replace(query, '[^a-z0-9]+', '', 'g') AS whole, list_transform(string_split(query, ' '), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')) AS words FROM q),
o AS (SELECT query, r_name, s_suppkey FROM w JOIN supplier ON contains(regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), whole) AND query NOT LIKE '____-%' JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT DISTINCT query, r_name FROM o), h AS (SELECT DISTINCT query, l_orderkey, r_name FROM o JOIN lineitem ON l_suppkey = s_suppkey),
t AS (SELECT query, o_orderkey, r_name, contains(day, query) OR (query NOT LIKE '____-%' AND len(list_filter([f, g], lambda x: contains(x, whole) OR len(list_filter(words, lambda y: NOT contains(x, y))) = 0)) > 0) AS hit FROM j, w)
SELECT t.query, o_orderkey FROM t LEFT JOIN r ON r.query = t.query AND r.r_name = t.r_name LEFT JOIN h ON h.query = t.query AND h.l_orderkey = o_orderkey AND h.r_name = t.r_name
WHERE CASE WHEN r.query IS NOT NULL THEN h.query IS NOT NULL ELSE hit END
""")
def q_journey_search(t):
    """Journeys that answer three queries: by the operators that a query names in the journey's region, elsewhere by texts and dates."""
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    ridden = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("operator_ids"))
    own = t.orders.join(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").join(regions, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    own = own.join(ridden, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fields = F.array(F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("c_mktsegment")), F.col("c_name"))
    own = own.select("o_orderkey", "region", "operator_ids", fields.alias("fields"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    operators = t.supplier.join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("region", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = [search.journeys(own, asked, operators, plain=["day"]).select(F.lit(asked).alias("query"), "o_orderkey") for asked in _ASKED]
    return found[0].unionByName(found[1]).unionByName(found[2])
