"""History overlays, inferred classes and staged matches over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators import overlay, relations, tally
from waybill.plans.registry import query

# Orders are features of their customer's line; each customer has four stamps, two for each of two operators.
OVERLAY_SQL = """
WITH f AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'stations' ELSE 'sections' END AS layer, o_custkey AS line, o_orderstatus AS operator, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 END AS x0,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 + o_orderkey % 7 END AS x1, CASE WHEN o_orderkey % 5 = 0 THEN '1990-01-01' END AS since, CASE WHEN o_orderkey % 4 = 0 THEN 'relocatedOld' ELSE 'current' END AS kind, CASE WHEN o_orderkey % 9 = 0 THEN 'own' END AS own FROM orders),
s AS (SELECT c_custkey AS line, operator, k AS place, 'h' || c_custkey || operator || '.new-' || k AS h, (c_custkey * k) % 30 AS x0, (c_custkey * k) % 30 + 25 AS x1, CASE (c_custkey + k) % 3 WHEN 1 THEN ['sections'] WHEN 2 THEN ['stations'] ELSE [] END AS layers,
  CASE WHEN (c_custkey + k) % 4 <> 0 THEN (1900 + (c_custkey * k) % 90)::VARCHAR || '-01-01' END AS since, CASE WHEN (c_custkey + k) % 2 = 0 THEN (1990 + (c_custkey + k) % 30)::VARCHAR || '-01-01' END AS until FROM customer, (SELECT unnest(['O', 'F']) AS operator), (SELECT unnest([1, 2]) AS k)),
m AS (SELECT f.id, s.* FROM f JOIN s ON f.line = s.line AND f.operator = s.operator AND f.x0 >= s.x0 AND f.x1 <= s.x1 AND (len(layers) = 0 OR list_contains(layers, layer)))
"""


def _overlay(t):
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    at = lambda v: F.when(key % 11 != 0, v)
    base = t.orders.select(
        key.alias("id"), F.when(key % 3 == 0, "stations").otherwise("sections").alias("layer"), F.col("o_custkey").alias("line_name"), F.col("o_orderstatus").alias("operator"), F.lit(None).cast("string").alias("station_name"),
        at(key % 50).alias("x0"), at(F.lit(0)).alias("y0"), at(key % 50 + key % 7).alias("x1"), at(F.lit(1)).alias("y1"),
        F.when(key % 5 == 0, "1990-01-01").alias("since"), F.lit(None).cast("string").alias("until"), F.when(key % 4 == 0, "relocatedOld").otherwise("current").alias("kind"), F.when(key % 9 == 0, "own").alias("history_id"),
    )
    each = t.customer.select("c_custkey", F.explode(F.array(F.lit("O"), F.lit("F"))).alias("operator")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    k, low = F.col("k"), (cust * F.col("k")) % 30
    layers = F.when((cust + k) % 3 == 1, F.array(F.lit("sections"))).when((cust + k) % 3 == 2, F.array(F.lit("stations"))).otherwise(F.array().cast("array<string>"))
    day = lambda year: F.concat(year.cast("string"), F.lit("-01-01"))
    stamps = each.select(
        k.alias("place"), F.concat(F.lit("h"), cust.cast("string"), "operator", F.lit(".new-"), k.cast("string")).alias("history_id"), cust.alias("line_name"), "operator", F.lit(None).cast("string").alias("station_name"),
        layers.alias("layers"), low.alias("x0"), F.lit(0).alias("y0"), (low + 25).alias("x1"), F.lit(1).alias("y1"),
        F.when((cust + k) % 4 != 0, day(1900 + (cust * k) % 90)).alias("since"), F.when((cust + k) % 2 == 0, day(1990 + (cust + k) % 30)).alias("until"),
    )
    gone = base.withColumn("id", -F.col("id")).withColumn("history_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), F.col("line_name").cast("string"), "operator", F.lit(".old-1"))))
    return overlay.applied(base, stamps, gone)


@query(f"""{OVERLAY_SQL}, g AS (SELECT id, arg_max(since, place) FILTER (since IS NOT NULL) AS since, arg_max(until, place) FILTER (until IS NOT NULL) AS until, arg_min(h, place) FILTER (since IS NOT NULL) AS h FROM m GROUP BY 1)
SELECT f.id, layer, coalesce(g.since, f.since, '-') AS since, coalesce(g.until, '-') AS until, CASE WHEN layer = 'sections' AND g.since IS NOT NULL AND kind = 'current' THEN 'relocatedNew' ELSE kind END AS kind, coalesce(own, CASE WHEN layer = 'sections' THEN g.h END, '-') AS history_id FROM f LEFT JOIN g ON f.id = g.id
UNION ALL SELECT -id, layer, coalesce(since, '-'), '-', CASE WHEN layer = 'stations' THEN kind WHEN id % 2 = 0 AND operator IN ('O', 'F') AND line IN (SELECT c_custkey FROM customer) THEN 'relocatedOld' ELSE 'historical' END, CASE WHEN id % 2 = 0 THEN 'h' || line || operator || '.old-1' ELSE '-' END FROM f
""")
def q_history_overlay(t):
    """Features with the stamps of their history, and the rows of what is gone with their kinds."""
    found = _overlay(t).features
    return found.select("id", "layer", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("since", "until")], "kind", F.coalesce("history_id", F.lit("-")).alias("history_id"))


@query(f"{OVERLAY_SQL} SELECT s.h AS history_id, count(m.id) AS matched FROM s LEFT JOIN m ON s.h = m.h GROUP BY 1")
def q_overlay_report(t):
    """How many features each stamp met, none included."""
    return _overlay(t).report


@query("""
WITH l AS (SELECT s_suppkey AS line, s_nationkey % 7 AS name, s_suppkey % 3 AS operator FROM supplier), k AS (SELECT c_mktsegment AS v, c_nationkey % 9 AS name, c_custkey % 4 AS operator FROM customer),
a AS (SELECT name, operator, arg_min(v, (-n, v)) AS v FROM (SELECT name, operator, v, count(*) AS n FROM k WHERE operator < 2 AND name < 4 GROUP BY ALL) GROUP BY 1, 2), b AS (SELECT name, arg_min(v, (-n, v)) AS v FROM (SELECT name, v, count(*) AS n FROM k WHERE name < 5 GROUP BY ALL) GROUP BY 1),
c AS (SELECT l_suppkey AS line, arg_min(v, (-n, v)) AS v FROM (SELECT l_suppkey, p_brand AS v, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY 1)
SELECT l.line, coalesce(a.v, b.v, c.v, '-') AS class, CASE WHEN a.v IS NOT NULL THEN 'name and operator' WHEN b.v IS NOT NULL THEN 'name' WHEN c.v IS NOT NULL THEN 'stations' ELSE '-' END AS source
FROM l LEFT JOIN a USING (name, operator) LEFT JOIN b USING (name) LEFT JOIN c ON c.line = l.line
""")
def q_class_vote(t):
    """A line's class by the majority of its name's and operator's sections, else of its name's, else by its stations' votes."""
    lines = t.supplier.select(F.col("s_suppkey").alias("line"), (F.col("s_nationkey") % 7).alias("name"), (F.col("s_suppkey") % 3).alias("operator"))
    known = t.customer.select(F.col("c_mktsegment").alias("v"), (F.col("c_nationkey") % 9).alias("name"), (F.col("c_custkey") % 4).alias("operator"))
    votes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("line"), F.col("p_brand").alias("v"))
    return tally.inferred(lines, [("name and operator", ["name", "operator"], known.where("operator < 2 and name < 4")), ("name", ["name"], known.where("name < 5")), ("stations", ["line"], votes)], "v").select("line", F.coalesce("v", F.lit("-")).alias("class"), F.coalesce("source", F.lit("-")).alias("source"))


STAGES = (("code", "p_name, p_brand, p_size"), ("geometry", "p_type, p_size"), ("name", "p_name"))


def _stages_sql() -> str:
    later = "p_partkey + 1000000000000 AS p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'now ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN 'now' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'now' ELSE p_type END AS p_type, p_size"
    out, a, b = f"a0 AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part), b0 AS (SELECT {later} FROM part)", "a0", "b0"
    for i, (name, keys) in enumerate(STAGES, 1):
        rank = f"row_number() OVER (PARTITION BY {keys} ORDER BY p_partkey) AS k"
        out += f""", m{i} AS (SELECT x.p_partkey AS old_id, y.p_partkey AS new_id, '{name}' AS stage FROM (SELECT *, {rank} FROM {a}) x JOIN (SELECT *, {rank} FROM {b}) y USING ({keys}, k)),
a{i} AS (SELECT * FROM {a} WHERE p_partkey NOT IN (SELECT old_id FROM m{i})), b{i} AS (SELECT * FROM {b} WHERE p_partkey NOT IN (SELECT new_id FROM m{i}))"""
        a, b = f"a{i}", f"b{i}"
    both = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, len(STAGES) + 1))
    return f"WITH {out}, m AS ({both} UNION ALL SELECT p_partkey, NULL, 'removed' FROM {a} UNION ALL SELECT NULL, p_partkey, 'added' FROM {b})"


@query(f"""{_stages_sql()}, d AS (SELECT m.*, concat_ws(',', CASE WHEN x.p_name IS DISTINCT FROM y.p_name THEN 'p_name' END, CASE WHEN x.p_brand IS DISTINCT FROM y.p_brand THEN 'p_brand' END, CASE WHEN x.p_type IS DISTINCT FROM y.p_type THEN 'p_type' END, CASE WHEN x.p_size IS DISTINCT FROM y.p_size THEN 'p_size' END) AS c
  FROM m LEFT JOIN a0 x ON x.p_partkey = old_id LEFT JOIN b0 y ON y.p_partkey = new_id)
SELECT coalesce(old_id, -1) AS old_id, coalesce(new_id, -1) AS new_id, stage, CASE WHEN stage IN ('removed', 'added') THEN '' ELSE c END AS changed FROM d""")
def q_three_stage_match(t):
    """Two states of a table matched by code, then geometry, then name, each pair with the fields that differ."""
    fields = ["p_name", "p_brand", "p_type", "p_size"]
    own = t.part.select(F.col("p_partkey").alias("id"), *fields)
    now = lambda n, c: F.when(F.col("id") % n == 0, F.concat(F.lit("now "), c) if c == "p_name" else F.lit("now")).otherwise(F.col(c)).alias(c)
    old, new = own, own.select((F.col("id") + 1_000_000_000_000).alias("id"), now(4, "p_name"), now(3, "p_brand"), now(2, "p_type"), "p_size")
    pairs = relations.cascade(old, new, "id", [(name, keys.split(", ")) for name, keys in STAGES])
    side = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"_{n}_{c}") for c in fields])
    both = pairs.join(side(old, "old").hint("merge"), "old_id", "left").join(side(new, "new").hint("merge"), "new_id", "left")
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), c) for c in fields])), ",")
    paired = F.col("old_id").isNotNull() & F.col("new_id").isNotNull()
    return both.select(F.coalesce("old_id", F.lit(-1)).alias("old_id"), F.coalesce("new_id", F.lit(-1)).alias("new_id"), "stage", F.when(paired, differ).otherwise("").alias("changed"))
