"""Records as they come in: dates of eras, checks before an import, drafts, concurrent writes, couplings, flattened shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import clock, geo, masks, text
from waybill.operators import rounds
from waybill.plans.registry import query


@query("""
WITH r AS (SELECT o_orderkey AS a, CASE o_orderkey % 3 WHEN 0 THEN 'couples_with' WHEN 1 THEN 'splits_from' ELSE 'continues_as' END AS kind, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
s AS (SELECT a, kind, b FROM r WHERE b IS NOT NULL UNION SELECT b, kind, a FROM r WHERE b IS NOT NULL AND kind = 'couples_with')
SELECT a, kind, b, x.o_orderstatus = y.o_orderstatus AS same FROM s JOIN orders x ON a = x.o_orderkey JOIN orders y ON b = y.o_orderkey
""")
def q_couplings(t):
    """Relations of trips with both trips' states; a coupling holds both ways."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "couples_with").when(key % 3 == 1, "splits_from").otherwise("continues_as")
    own = t.orders.select(key.alias("a"), kind.alias("kind"), F.lag(key).over(w).alias("b")).where("b is not null")
    own = own.union(own.where("kind = 'couples_with'").select("b", "kind", "a")).distinct()
    state = lambda end: t.orders.select(key.alias(end), F.col("o_orderstatus").alias(f"s_{end}"))
    return own.join(state("a"), "a").join(state("b"), "b").select("a", "kind", "b", (F.col("s_a") == F.col("s_b")).alias("same"))


@query("""
WITH x AS (SELECT n_name AS country, l_partkey, l_suppkey, l_extendedprice AS km, s_nationkey % 4 = 0 AND l_extendedprice < 5000 AS bad, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT country, CASE WHEN bool_or(bad) THEN 0 ELSE count(DISTINCT (l_partkey, l_suppkey)) END AS edges, coalesce('short edge of ' || CAST(min(CASE WHEN bad THEN l_orderkey END) AS VARCHAR), '') AS error FROM x GROUP BY 1
""")
def q_country_errors(t):
    """Edges of each country; one with an unusable row has none and one recorded error, and leaves the others as they are."""
    places = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("country"), (F.col("s_nationkey") % 4 == 0).alias("strict"))
    own = t.lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select("country", "l_partkey", "l_suppkey", F.when(F.col("strict") & (F.col("l_extendedprice") < 5000), F.col("l_orderkey")).alias("bad"))
    by = rounds.dealt(own, "l_partkey", "l_suppkey").groupBy("country", "l_partkey", "l_suppkey").agg(F.min("bad").alias("bad")).groupBy("country").agg(F.count("*").alias("n"), F.min("bad").alias("bad"))
    error = F.concat(F.lit("short edge of "), F.col("bad").cast("string"))
    return by.select("country", F.when(F.col("bad").isNull(), F.col("n")).otherwise(0).alias("edges"), F.coalesce(error, F.lit("")).alias("error"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_shipdate < DATE '1997-01-01' GROUP BY 1, 2),
g AS (SELECT l_orderkey, max(n) AS most, count(*) AS legs, min(l_linenumber) AS first_leg, max(l_linenumber) AS last_leg FROM v GROUP BY 1)
SELECT l_orderkey, legs, first_leg, last_leg FROM g WHERE most = 1 AND last_leg - first_leg + 1 = legs
""")
def q_pattern_legs(t):
    """Legs of a pattern in force: each with exactly one variant and none missing between them; else the pattern gives nothing."""
    variants = t.lineitem.where(F.col("l_shipdate") < "1997-01-01").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    legs = variants.groupBy("l_orderkey").agg(F.max("n").alias("most"), F.count("*").alias("legs"), F.min("l_linenumber").alias("first_leg"), F.max("l_linenumber").alias("last_leg"))
    return legs.where("most = 1 and last_leg - first_leg + 1 = legs").drop("most")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE strftime(o_orderdate + (o_orderkey % 3) * INTERVAL 10 YEAR, '%Y-%m-%d') END AS day FROM orders
""")
def q_era_day(t):
    """Dates written in years of an era; another era's are unknown."""
    key = F.col("o_orderkey")
    day = F.add_months("o_orderdate", (key % 3 * 120).cast("int"))
    reiwa = F.year(day) >= 2020
    year = F.year(day) - F.when(reiwa, 2018).otherwise(1988)
    era = F.when(key % 10 == 0, "昭和").when(reiwa, "令和").otherwise("平成")
    written = F.concat(era, year.cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    return t.orders.select("o_orderkey", F.coalesce(clock.era_day(written).cast("string"), F.lit("unknown")).alias("day"))


@query("""
WITH n AS (SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN '😀' WHEN 1 THEN 'ｱ' ELSE 'z' END || p_name AS name FROM part)
SELECT p_brand, arg_max(name, replace(name, '😀', chr(55295))) AS utf16_last, max(name) AS code_point_last FROM n GROUP BY 1
""")
def q_utf16_order(t):
    """The last name of each brand by UTF-16 code units and by code points, which differ above U+FFFF."""
    key = F.col("p_partkey") % 3
    own = t.part.select("p_brand", F.concat(F.when(key == 0, "😀").when(key == 1, "ｱ").otherwise("z"), "p_name").alias("name"))
    return own.groupBy("p_brand").agg(F.max_by("name", text.utf16_key(F.col("name"))).alias("utf16_last"), F.max("name").alias("code_point_last"))


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unreadable_time' WHEN c_custkey IS NULL THEN 'unknown_rider' WHEN row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d %H:%M') ORDER BY event_id) > 1 THEN 'repeated' ELSE 'ok' END AS verdict
  FROM events LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 4 <> 0) ON user_id = c_custkey)
SELECT verdict, count(*) AS n, min(event_id) AS first_id FROM v GROUP BY 1
""")
def q_import_preflight(t):
    """What an import would do, over every row and without writing: the first rule that a row breaks decides."""
    at = F.when(F.col("event_id") % 11 == 0, F.date_format("ts", "HH:99")).otherwise(F.date_format("ts", "HH:mm"))
    known = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known")).distinct()
    same = Window.partitionBy("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm")).orderBy("event_id")
    own = t.events.select("event_id", "user_id", "ts").join(known, "user_id", "left").withColumn("nth", F.row_number().over(same))
    verdict = masks.first_rule([(clock.editor_minutes(at).isNull(), "unreadable_time"), (F.col("known").isNull(), "unknown_rider"), (F.col("nth") > 1, "repeated")], "ok")
    return own.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS calls, bool_or(l_shipdate < o_orderdate + INTERVAL 3 DAY) AS early, count(DISTINCT l_linenumber) < count(*) AS twice FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'no_date' END, CASE WHEN coalesce(calls, 0) < 2 THEN 'too_few_calls' END, CASE WHEN early THEN 'ends_before_start' END, CASE WHEN twice THEN 'repeated_call' END) AS issues,
  o_orderkey % 11 = 0 OR coalesce(calls, 0) < 2 AS blocks FROM orders LEFT JOIN c ON o_orderkey = l_orderkey
""")
def q_draft_issues(t):
    """All issues of each draft in a fixed order, and whether one of them forbids saving it."""
    dated = rounds.dealt(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    lines = rounds.dealt(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"), "o_orderkey")
    # lines by number first, so that neither distinct numbers nor lines are held or joined
    numbers = lines.groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"))
    by = numbers.groupBy("o_orderkey").agg(F.sum("n").alias("calls"), F.min("first").alias("first"), (F.count("l_linenumber") < F.sum("n")).alias("twice"))
    early = F.col("first") < F.col("o_orderdate") + F.expr("interval 3 day")
    undated, few = F.col("o_orderkey") % 11 == 0, F.coalesce("calls", F.lit(0)) < 2
    issues = [F.when(undated, "no_date"), F.when(few, "too_few_calls"), F.when(early, "ends_before_start"), F.when(F.col("twice"), "repeated_call")]
    return dated.join(by, "o_orderkey", "left").select("o_orderkey", F.concat_ws(",", *issues).alias("issues"), (undated | few).alias("blocks"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 3 = l_orderkey % 3 AS fits FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, fits ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM w)
SELECT l_orderkey, count(CASE WHEN fits AND k = 1 THEN 1 END) AS applied, count(CASE WHEN NOT fits THEN 1 END) AS stale, count(CASE WHEN fits AND k > 1 THEN 1 END) AS late, coalesce(min(CASE WHEN fits AND k = 1 THEN l_suppkey END), -1) AS "value" FROM k GROUP BY 1
""")
def q_conflicting_writes(t):
    """Writes against the version that each expects: the first that fits is applied, later ones and stale ones are conflicts."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    writes = t.lineitem.select("l_orderkey", *order, (F.col("l_linenumber") % 3).alias("expected"))
    fits = F.col("expected") == F.col("l_orderkey") % 3
    by = writes.groupBy("l_orderkey").agg(F.count(F.when(fits, 1)).alias("n"), F.count(F.when(~fits, 1)).alias("stale"), F.min(F.when(fits, F.struct(*order))).alias("first"))
    return by.select("l_orderkey", F.least("n", F.lit(1)).alias("applied"), "stale", F.greatest(F.col("n") - 1, F.lit(0)).alias("late"), F.coalesce("first.l_suppkey", F.lit(-1)).alias("value"))


@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS pos, l_suppkey::DOUBLE AS x, l_linenumber::DOUBLE AS y FROM lineitem
""")
def q_geometry_flatten(t):
    """Coordinates of lines, and of lines in several parts, read from their JSON in order."""
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    own = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("p"))
    joined = lambda start, end: F.array_join(F.transform("p", lambda v: F.concat(F.lit(start), v["l_suppkey"].cast("string"), F.lit(","), v["l_linenumber"].cast("string"), F.lit(end))), ",")
    shape = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('{"type":"LineString","coordinates":['), joined("[", "]"), F.lit("]}"))).otherwise(
        F.concat(F.lit('{"type":"MultiLineString","coordinates":['), joined("[[", "]]"), F.lit("]}"))
    )
    own = own.select("l_orderkey", shape.alias("shape"))
    kind = F.get_json_object("shape", "$.type")
    one = F.from_json("shape", "coordinates array<array<double>>").getField("coordinates")
    parts = F.flatten(F.from_json("shape", "coordinates array<array<array<double>>>").getField("coordinates"))
    flat = own.select("l_orderkey", F.posexplode(F.when(kind == "LineString", one).when(kind == "MultiLineString", parts)).alias("pos", "c"))
    return flat.select("l_orderkey", "pos", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))


@query("""
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' WHEN 2 THEN 'renamed' WHEN 3 THEN 'moved' ELSE 'changed' END AS kind FROM part WHERE p_partkey % 10 < 5
""")
def q_moved_renamed(t):
    """Kinds of change between two snapshots: a new name alone is a renaming, a new place alone a move, both a change."""
    key = F.col("p_partkey") % 10
    old = t.part.where(key != 1).select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("place")).alias("o"))
    name = F.when(key.isin(2, 4), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    place = F.when(key.isin(3, 4), F.col("p_size") + 1).otherwise(F.col("p_size"))
    new = t.part.where(key != 0).select("p_partkey", F.struct(name.alias("name"), place.alias("place")).alias("n"))
    named, placed = F.col("o.name").eqNullSafe(F.col("n.name")), F.col("o.place").eqNullSafe(F.col("n.place"))
    kind = masks.first_rule([(F.col("n").isNull(), "removed"), (F.col("o").isNull(), "added"), (named & placed, "same"), (placed, "renamed"), (named, "moved")], "changed")
    return old.join(new, "p_partkey", "full").select("p_partkey", kind.alias("kind")).where("kind <> 'same'")


@query("""
SELECT DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders
""")
def q_available_dates(t):
    """The days that have journeys, undated ones last."""
    day = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select(day.alias("day")).distinct().orderBy(F.asc_nulls_last("day")).select(F.coalesce("day", F.lit("undated")).alias("day"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '[' || (((l_partkey * 7919) % 4001 - 2000) / 1e7)::VARCHAR || ',' || (l_suppkey * 12345 / 1e7 - l_linenumber)::DECIMAL(18, 7)::DOUBLE::VARCHAR || ']' AS c FROM lineitem),
s AS (SELECT l_orderkey, '[' || string_agg(c, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS f, '[' || string_agg(c, ',' ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) || ']' AS b FROM p GROUP BY 1)
SELECT l_orderkey, 'geom-' || left(sha256(least(f, b)), 32) AS id, f <= b AS forward FROM s
""")
def q_geometry_ids(t):
    """Ids of lines in seven decimals, the same in both directions; coordinates of all sizes, below 0.0001 and negative ones too."""
    lon = ((F.col("l_partkey") * 7919) % 4001 - 2000) / F.lit(1e7)
    lat = F.col("l_suppkey") * 12345 / F.lit(1e7) - F.col("l_linenumber")
    key = ["l_linenumber", "l_partkey", "l_suppkey"]
    # texts are made row by row, after the shuffle, where code is generated for them
    rows = rounds.dealt(t.lineitem.select("l_orderkey", *key), "l_orderkey").withColumn("text", geo.point_json(lon, lat))
    own = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*key, "text")))["text"].alias("texts"))
    own = own.withColumn("geometry", geo.undirected_texts(F.col("texts")))
    first = F.concat(F.lit("["), F.get("texts", F.lit(0)))
    return own.select("l_orderkey", geo.geometry_id(F.col("geometry")).alias("id"), F.startswith("geometry", first).alias("forward"))
