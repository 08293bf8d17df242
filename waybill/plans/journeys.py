"""Statistics of journeys: tallies, coverage, extremes, distributions. Journeys are orders, their calls are lineitems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import clock, geo, masks
from waybill.operators import coverage, tally
from waybill.plans.registry import query

ROUTES_SQL = """
  SELECT o_orderkey, least(cn.n_name, sn.n_name) AS place_a, greatest(cn.n_name, sn.n_name) AS place_b, l_extendedprice AS km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
"""


def routes(t):
    """Each call with both places of its route, in order."""
    places = t.nation.select("n_nationkey", "n_name")
    a, b = geo.undirected(F.col("c_name_"), F.col("s_name_"))
    return (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice")
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name_")), "s_nationkey")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_name_")), "c_nationkey")
        .select("o_orderkey", a.alias("place_a"), b.alias("place_b"), F.col("l_extendedprice").alias("km"))
    )


@query(f"""
SELECT place_a, place_b, count(*) AS rides, round(sum(km), 2) AS km,
  row_number() OVER (ORDER BY count(*) DESC, round(sum(km), 2) DESC, place_a, place_b) AS place
FROM ({ROUTES_SQL}) GROUP BY place_a, place_b
""")
def q_passport_tally(t):
    return tally.ranked(routes(t), ["place_a", "place_b"], F.col("km"))


@query("""
SELECT 'year' AS part, year(o_orderdate)::BIGINT AS value, count(*) AS rides FROM orders GROUP BY 2
UNION ALL SELECT 'month', m, count(o_orderkey) FROM range(1, 13) r(m) LEFT JOIN orders ON month(o_orderdate) = m GROUP BY m
UNION ALL SELECT 'weekday', d, count(o_orderkey) FROM range(1, 8) r(d) LEFT JOIN orders ON dayofweek(o_orderdate) + 1 = d GROUP BY d
""")
def q_year_month_weekday(t):
    day = F.col("o_orderdate")
    own = t.orders.select("o_orderdate")
    years = own.groupBy(F.year(day).cast("long").alias("value")).agg(F.count("*").alias("rides")).select(F.lit("year").alias("part"), "value", "rides")
    month = tally.zero_filled(own, F.month(day), 1, 12).select(F.lit("month").alias("part"), "value", "rides")
    weekday = tally.zero_filled(own, F.dayofweek(day), 1, 7).select(F.lit("weekday").alias("part"), "value", "rides")
    return years.union(month).union(weekday)


@query("""
SELECT coalesce(y, 0) AS year, coalesce(m, 0) AS month, count(*) AS rides, round(sum(o_totalprice), 2) AS km
FROM (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, * FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ROLLUP (y, m)
""")
def q_rollup_distribution(t):
    own = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(t.customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = own.rollup(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("rides"), F.round(F.sum("o_totalprice"), 2).alias("km"))
    return by.select(F.coalesce("y", F.lit(0)).alias("year"), F.coalesce("m", F.lit(0)).alias("month"), "rides", "km")


@query("""
WITH j AS (SELECT r_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS region, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS longest_id, max(o_totalprice) AS longest,
  arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS shortest_id, min(o_totalprice) AS shortest FROM j GROUP BY 1
""")
def q_extremes(t):
    return tally.extremes(by_region(t), "region", "o_orderkey", "o_totalprice")


def by_region(t):
    return (
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region.select("r_regionkey", F.col("r_name").alias("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def bits(kind, size):
    return masks.mask([(1, kind.contains("STEEL")), (2, kind.contains("BRASS")), (4, size <= 15), (8, size > 35), (16, kind.startswith("P"))])


BITS_SQL = """(CASE WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0 END | CASE WHEN p_type LIKE '%BRASS%' THEN 2 ELSE 0 END | CASE WHEN p_size <= 15 THEN 4 ELSE 0 END
  | CASE WHEN p_size > 35 THEN 8 ELSE 0 END | CASE WHEN p_type LIKE 'P%' THEN 16 ELSE 0 END)"""
EDGES_SQL = f"""SELECT l_partkey, l_suppkey, min(l_extendedprice) AS km, bit_or({BITS_SQL}) AS mask FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def edges(t):
    own = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice").join(t.part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return coverage.distinct_edges(own.withColumn("mask", bits(F.col("p_type"), F.col("p_size"))), ["l_partkey", "l_suppkey"], "l_extendedprice", "mask")


@query(f"""
WITH e AS ({EDGES_SQL})
SELECT category, count(*) AS edges, round(sum(km), 2) AS km FROM e, (VALUES ('steel', 1), ('brass', 2), ('small', 4), ('large', 8), ('plain', 16)) c(category, bit)
WHERE mask & bit <> 0 GROUP BY 1 UNION ALL SELECT 'all', count(*), round(sum(km), 2) FROM e
""")
def q_coverage_by_category(t):
    return coverage.by_category(edges(t), {"steel": 1, "brass": 2, "small": 4, "large": 8, "plain": 16})


@query(f"""
WITH e AS ({EDGES_SQL}), b AS (
  SELECT l_suppkey, CASE WHEN mask & 1 <> 0 THEN 'steel' WHEN mask & 2 <> 0 THEN 'brass' WHEN mask & 4 <> 0 THEN 'small' WHEN mask & 8 <> 0 THEN 'large' ELSE 'other' END AS bucket,
    round(sum(km), 2) AS km FROM e GROUP BY 1, 2)
SELECT l_suppkey, bucket, km FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY km DESC, bucket) = 1
""")
def q_exclusive_bucket(t):
    bucket = masks.exclusive(F.col("mask"), [(1, "steel"), (2, "brass"), (4, "small"), (8, "large")], "other")
    return tally.dominant(edges(t).withColumn("bucket", bucket), ["l_suppkey"], "bucket", "km")


@query("""
WITH k AS (SELECT l_partkey, s_name AS owner, round(sum(l_extendedprice), 2) AS km FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT l_partkey, owner, km FROM k QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY km DESC, owner) = 1
""")
def q_majority_owner(t):
    own = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("km")).join(t.supplier.select("s_suppkey", F.col("s_name").alias("owner")), F.col("l_suppkey") == F.col("s_suppkey"))
    return tally.dominant(own, ["l_partkey"], "owner", "km")


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT o_custkey, o_orderpriority AS modal, count(*) OVER (PARTITION BY o_custkey) AS variants FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1),
a AS (SELECT o_custkey, count(*) AS rides, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1)
SELECT o_custkey, modal, variants, rides, mean FROM a JOIN m USING (o_custkey)
""")
def q_modal_summary(t):
    own = t.orders.select("o_custkey", "o_orderpriority", "o_totalprice")
    modal = tally.modal(own, ["o_custkey"], "o_orderpriority")
    return own.groupBy("o_custkey").agg(F.count("*").alias("rides"), F.round(F.avg("o_totalprice"), 6).alias("mean")).join(modal, "o_custkey").select("o_custkey", "modal", "variants", "rides", "mean")


@query("""
SELECT p_brand, round(sum(l_extendedprice), 2) AS km,
  CASE WHEN sum(l_extendedprice) >= 1e8 THEN 4 WHEN sum(l_extendedprice) >= 1e7 THEN 6 WHEN sum(l_extendedprice) >= 1e6 THEN 8 ELSE 10 END AS zoom
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def q_group_zoom(t):
    own = t.lineitem.select("l_partkey", "l_extendedprice").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    total = F.sum("l_extendedprice")
    return own.groupBy("p_brand").agg(F.round(total, 2).alias("km"), tally.steps(total, [(1e8, 4), (1e7, 6), (1e6, 8)], 10).alias("zoom"))


@query("""
SELECT p_brand, floor(log2(1e6 / (sum(l_extendedprice) / count(*))) + 0.5)::BIGINT AS raw,
  least(14, greatest(3, floor(log2(1e6 / (sum(l_extendedprice) / count(*))) + 0.5)))::BIGINT AS zoom
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def q_density_zoom(t):
    own = t.lineitem.select("l_partkey", "l_extendedprice").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    raw = F.floor(F.log2(F.lit(1e6) / (F.sum("l_extendedprice") / F.count("*"))) + 0.5)
    return own.groupBy("p_brand").agg(raw.cast("long").alias("raw"), F.least(F.lit(14), F.greatest(F.lit(3), raw)).cast("long").alias("zoom"))


@query("""
SELECT o_orderpriority, count(*) AS rides, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS timed,
  round(avg(CASE WHEN o_totalprice > 100000 THEN o_totalprice END), 4) AS mean_known, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1
""")
def q_conditional_means(t):
    return tally.means_of_known(t.orders, ["o_orderpriority"], F.col("o_totalprice"), F.col("o_totalprice") > 100000)


@query("""
WITH k AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_partkey, l_suppkey, l_extendedprice AS km, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS bit, l_orderkey, l_linenumber FROM lineitem)
SELECT a, b, arg_min(km, (l_orderkey, l_linenumber, l_partkey, l_suppkey, km)) AS km, bit_or(bit) AS bits FROM k GROUP BY 1, 2
""")
def q_historical_lines(t):
    a, b = geo.undirected(F.col("l_partkey"), F.col("l_suppkey"))
    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    own = t.lineitem.select(a.alias("a"), b.alias("b"), bit.alias("bit"), F.col("l_extendedprice").alias("km"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice")).alias("at"))
    return own.groupBy("a", "b").agg(F.min_by("km", "at").alias("km"), F.bit_or("bit").alias("bits"))


@query("""
SELECT r_name AS region, count(*) AS rides, round(sum(o_totalprice), 2) AS km, round(count(*) / sum(count(*)) OVER (), 6) AS ride_share
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def q_region_share(t):
    by = by_region(t).groupBy("region").agg(F.count("*").alias("rides"), F.round(F.sum("o_totalprice"), 2).alias("km"))
    return by.withColumn("ride_share", F.round(F.col("rides") / F.sum("rides").over(Window.partitionBy()), 6))


@query("""
SELECT o_orderstatus AS kind, o_orderpriority AS part, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS part_share FROM orders GROUP BY 1, 2
""")
def q_counts(t):
    by = t.orders.groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("part")).agg(F.count("*").alias("n"))
    return by.withColumn("part_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END NULLS LAST,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS place
FROM orders
""")
def q_date_order(t):
    key, last = F.col("o_orderkey"), F.lit((1 << 63) - 1)
    day = F.when(key % 11 != 0, F.col("o_orderdate"))
    departure = F.when(key % 5 != 0, F.col("o_totalprice"))
    # ranges in the order of places: only their counts are summed up in one task
    ranges = [
        F.coalesce(F.unix_micros(day.cast("timestamp")), last).alias("r"),
        F.coalesce(F.floor(departure / 5000), last).alias("s"),
        F.when(departure.isNull(), F.floor(key / 100_000)).otherwise(F.lit(0)).alias("u"),
    ]
    own = t.orders.select("o_orderkey", "o_orderdate", departure.alias("p"), *ranges)
    before = Window.orderBy("r", "s", "u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy("r", "s", "u").agg(F.count("*").alias("n")).select("r", "s", "u", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("r", "s", "u").orderBy(F.asc_nulls_last("p"), "o_orderkey"))
    placed = own.withColumn("within", within).join(offsets, ["r", "s", "u"])
    return placed.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("offset") + F.col("within")).alias("place"))


@query("""
SELECT DISTINCT y FROM (SELECT year(o_orderdate)::INT AS y FROM orders UNION ALL VALUES (2026), (1990)) ORDER BY y DESC
""")
def q_years_desc(t):
    fixed = t.spark.createDataFrame([(2026,), (1990,)], "y int")
    return t.orders.select(F.year("o_orderdate").alias("y")).distinct().union(fixed).distinct().orderBy(F.desc("y"))


@query("""
WITH k AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE s_name END AS owner, p_name AS name, p_type AS category, round(sum(l_extendedprice), 2) AS km
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT owner, name, arg_max(category, (km, category)) AS category, round(sum(km), 2) AS km FROM k GROUP BY 1, 2
""")
def q_coverage_rows(t):
    own = (
        t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice")
        .join(t.part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    owner = F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("s_name"))
    by = own.groupBy(owner.alias("owner"), F.col("p_name").alias("name"), F.col("p_type").alias("category")).agg(F.round(F.sum("l_extendedprice"), 2).alias("km"))
    rows = by.groupBy("owner", "name").agg(F.max_by("category", F.struct("km", "category")).alias("category"), F.round(F.sum("km"), 2).alias("km"))
    return rows.orderBy(F.col("owner") == "", "owner", "name")


@query("""
WITH j AS (SELECT o_orderkey, r_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' AND NOT (strftime(o_orderdate, '%Y-%m-%d') IN ('1996-02-29', '1997-03-01')))
SELECT r_name AS region, count(CASE WHEN o_totalprice >= 50000 THEN 1 END) AS taken, count(CASE WHEN o_totalprice < 50000 THEN 1 END) AS excluded,
  coalesce(min(CASE WHEN o_orderdate >= DATE '1997-06-01' THEN (o_orderdate, o_orderkey) END)['o_orderkey'], 0) AS next_id FROM (SELECT * FROM j) GROUP BY 1
""".replace("min(CASE WHEN o_orderdate >= DATE '1997-06-01' THEN (o_orderdate, o_orderkey) END)['o_orderkey']", "arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= DATE '1997-06-01')"))
def q_membership_slice(t):
    day = F.col("o_orderdate")
    own = by_region(t).where((day >= "1996-01-01") & (day < "1998-01-01") & ~F.date_format(day, "yyyy-MM-dd").isin("1996-02-29", "1997-03-01"))
    sure = F.col("o_totalprice") >= 50000
    return own.groupBy("region").agg(
        F.count(F.when(sure, 1)).alias("taken"),
        F.count(F.when(~sure, 1)).alias("excluded"),
        F.coalesce(F.min(F.when(day >= "1997-06-01", F.struct("o_orderdate", "o_orderkey")))["o_orderkey"], F.lit(0)).alias("next_id"),
    )


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS declared, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE n_name END AS of_stop, r_name AS fallback
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT o_orderkey, coalesce(declared, of_stop, fallback) AS region, concat_ws('>', declared, of_stop, fallback) AS touched FROM x
""")
def q_region_rule(t):
    own = by_region(t).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    declared = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    of_stop = F.when(F.col("o_orderkey") % 2 != 0, F.col("n_name"))
    return own.select(
        "o_orderkey",
        F.coalesce(declared, of_stop, F.col("region")).alias("region"),
        F.array_join(F.array_distinct(F.array_compact(F.array(declared, of_stop, F.col("region")))), ">").alias("touched"),
    )


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2),
m AS (SELECT user_id, day, hour(a) * 60 + minute(a) AS s, (hour(b) * 60 + minute(b) + 700) % 1440 AS e FROM d)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, (CASE WHEN e < s THEN e + 1440 ELSE e END - s)::BIGINT AS minutes FROM m
""")
def q_ride_minutes(t):
    own = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start = F.hour("a") * 60 + F.minute("a")
    end = (F.hour("b") * 60 + F.minute("b") + 700) % 1440
    return own.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), clock.ride_minutes(start, end).cast("long").alias("minutes"))
