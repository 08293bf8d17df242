"""Ordered events and calls, and dated facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import clock, masks, text
from waybill.operators import periods, sequences
from waybill.plans.registry import query

CALL = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(end_m - l_extendedprice, 2) AS start_m, round(end_m, 2) AS end_m FROM (
  SELECT *, sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS end_m FROM lineitem)
""")
def q_prefix_measure(t):
    own = t.lineitem.select("l_orderkey", *CALL)
    m = sequences.measures(own, ["l_orderkey"], CALL, "l_extendedprice")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", F.round("start_m", 2).alias("start_m"), F.round("end_m", 2).alias("end_m"))


@query("""
WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM events)
SELECT event_id, user_id, coalesce(strftime(since, '%Y-%m-%d %H:%M:%S'), '-') AS since FROM e WHERE event_type <> 'signup'
""")
def q_validity_asof(t):
    own = periods.as_of(t.events.select("event_id", "user_id", "ts", "event_type"), F.col("event_type") == "signup", ["user_id"], "ts", "since")
    return own.select("event_id", "user_id", F.coalesce(F.date_format("since", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("since"))


@query("""
SELECT a.o_custkey AS custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b
ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY
""")
def q_interval_overlap(t):
    day = F.to_date("o_orderdate")
    own = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", day.alias("s"), F.date_add(day, 30).alias("u"))
    return periods.overlapping(own, ["custkey"], "o_orderkey", "s", "u", 60)


PERIODS_SQL = """SELECT o_custkey, o_orderdate::DATE AS s, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt,
  least(o_orderdate::DATE + 60, DATE '2000-01-01') AS u FROM orders WHERE o_orderdate < DATE '2000-01-01' AND o_orderdate >= DATE '1996-01-01'"""


@query(f"""
WITH p AS ({PERIODS_SQL}), c AS (SELECT o_custkey, s, u, max(u) OVER (PARTITION BY o_custkey ORDER BY s, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p WHERE s < u),
x AS (SELECT o_custkey, coalesce(m, DATE '1996-01-01') AS since, s AS until, 'gap' AS kind FROM c WHERE coalesce(m, DATE '1996-01-01') < s
  UNION ALL SELECT o_custkey, greatest(coalesce(m, s), s), u, 'piece' FROM c WHERE greatest(coalesce(m, s), s) < u
  UNION ALL SELECT o_custkey, max(u), DATE '2000-01-01', 'gap' FROM c GROUP BY 1 HAVING max(u) < DATE '2000-01-01')
SELECT o_custkey, strftime(since, '%Y-%m-%d') AS since, strftime(until, '%Y-%m-%d') AS until, kind FROM x
""")
def q_identity_split(t):
    day = F.to_date("o_orderdate")
    own = t.orders.where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "2000-01-01")).select("o_custkey", day.alias("s"), F.date_add(day, 60).alias("u"))
    cut = periods.split(own, ["o_custkey"], "s", "u", "1996-01-01", "2000-01-01")
    return cut.select("o_custkey", F.date_format("since", "yyyy-MM-dd").alias("since"), F.date_format("until", "yyyy-MM-dd").alias("until"), "kind")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderdate::DATE AS f, o_orderdate::DATE + 21 AS u, (o_orderkey % 127 + 1)::INT AS bits FROM orders),
d AS (SELECT id, f, u, bits, x::DATE AS day FROM c, range(TIMESTAMP '1996-01-01', TIMESTAMP '1996-04-01', INTERVAL 1 DAY) r(x)),
e AS (SELECT *, CASE WHEN day = f + 3 THEN 'remove' WHEN day = u + 2 THEN 'add' END AS exc FROM d)
SELECT id::VARCHAR AS trip_id, strftime(day, '%Y-%m-%d') AS service_date FROM e
WHERE CASE WHEN exc = 'remove' THEN false WHEN exc = 'add' THEN true WHEN NOT (f <= day AND day < u) THEN false ELSE (bits >> dayofweek(day)) & 1 = 1 END
""")
def q_calendar_expand(t):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    own = t.orders.select(key.cast("string").alias("id"), day.alias("f"), F.date_add(day, 21).alias("u"), (key % 127 + 1).cast("int").alias("bits"))
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    calendars = own.select(
        F.col("id").alias("calendar_id"), *[F.shiftright("bits", k).bitwiseAND(F.lit(1)).alias(n) for k, n in enumerate(names)],
        F.col("f").cast("string").alias("valid_from"), F.col("u").cast("string").alias("valid_until"),
    )
    exceptions = own.select(F.col("id").alias("calendar_id"), F.inline(F.array(
        F.struct(F.date_add("f", 3).alias("service_date"), F.lit("remove").alias("exception_type")), F.struct(F.date_add("u", 2).alias("service_date"), F.lit("add").alias("exception_type")),
    )))
    versions = t.spark.createDataFrame([("v", None, "")], "timetable_version_id string, effective_from string, effective_until string")
    trips = own.select(F.col("id").alias("trip_id"), F.lit("v").alias("timetable_version_id"), F.col("id").alias("calendar_id"))
    found = periods.service_days(trips, calendars, exceptions, versions, "1996-01-01", "1996-04-01")
    return found.select("trip_id", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 14 = 0 THEN '-' WHEN o_orderkey % 7 = 0 THEN 'override' ELSE o_orderpriority END AS priority FROM orders
""")
def q_override_join(t):
    base = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority"))
    clear = F.col("o_orderkey") % 14 == 0
    changes = base.where(F.col("o_orderkey") % 7 == 0).select("o_orderkey", "day", F.when(~clear, "override").alias("priority"), clear.cast("int").alias("priority_present"))
    return periods.overridden(base, changes, ["o_orderkey", "day"], ["priority"]).select("o_orderkey", "day", F.coalesce("priority", F.lit("-")).alias("priority"))


RUNS_SQL = """
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT user_id, run::BIGINT AS run, first(event_type) AS event_type, count(*) AS n, min(ts) AS a, max(ts) AS b FROM r GROUP BY user_id, run)
"""


def event_runs(t):
    return sequences.runs(t.events.select("user_id", "ts", "event_type"), ["user_id"], ["ts"], "event_type")


@query(RUNS_SQL + "SELECT user_id, run, event_type, n FROM g")
def q_runs(t):
    return event_runs(t).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


@query(RUNS_SQL + """SELECT user_id, count(*) AS runs, sum(n)::BIGINT AS total, arg_max(event_type, (n, -run)) AS longest, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS since,
  strftime(max(b), '%Y-%m-%d %H:%M:%S') AS until FROM g WHERE n >= 2 GROUP BY 1""")
def q_run_stats(t):
    own = event_runs(t).where("n >= 2")
    return own.groupBy("user_id").agg(
        F.count("*").alias("runs"), F.sum("n").alias("total"), F.max_by("event_type", F.struct(F.col("n"), -F.col("run"))).alias("longest"),
        F.date_format(F.min("first"), "yyyy-MM-dd HH:mm:ss").alias("since"), F.date_format(F.max("last"), "yyyy-MM-dd HH:mm:ss").alias("until"),
    )


@query(RUNS_SQL + ", x AS (SELECT user_id, string_agg(event_type, '>' ORDER BY run) AS path FROM g GROUP BY 1) SELECT * FROM x")
def q_collapse_repeats(t):
    items = sequences.in_order(t.events, ["user_id"], ["ts"], "event_type", "items")
    return items.select("user_id", F.array_join(sequences.without_repeats(F.col("items")), ">").alias("path"))


@query("""
SELECT l_orderkey, l_linenumber, concat(l_partkey, ':', l_suppkey, CASE WHEN count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1
  THEN concat('~', row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice)) ELSE '' END) AS code FROM lineitem
""")
def q_occurrence_suffix(t):
    own = sequences.occurrence_codes(t.lineitem.select("l_orderkey", *CALL), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return own.select("l_orderkey", "l_linenumber", "code")


@query("""
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT) // 60 - 240 END AS m FROM events),
d AS (SELECT *, floor(m / 1440.0)::BIGINT AS d, max(floor(m / 1440.0)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m)
SELECT event_id, coalesce(greatest(d, p), -99) AS day, coalesce(d > p, false) AS breaks FROM d
""")
def q_day_breaks(t):
    minutes = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 60) - 240
    own = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, minutes).alias("m"))
    return sequences.day_breaks(own, ["user_id"], ["ts"], "m").select("event_id", F.coalesce("day", F.lit(-99)).cast("long").alias("day"), "breaks")


@query("""
WITH c AS (SELECT event_id, CASE WHEN hour(ts) < 4 THEN hour(ts) + 24 ELSE hour(ts) END AS h, minute(ts) AS m FROM events)
SELECT event_id, printf('%02d:%02d', h, m) AS clock, (h * 60 + m)::INT AS minutes, h >= 24 AS crosses, (h * 60 + m + 1440)::INT AS plus_one FROM c
""")
def q_parse_clock(t):
    hour = F.when(F.hour("ts") < 4, F.hour("ts") + 24).otherwise(F.hour("ts"))
    own = t.events.select("event_id", clock.clock_text(hour * 3600 + F.minute("ts") * 60).alias("clock"))
    return own.select("event_id", "clock", clock.minutes(F.col("clock")).alias("minutes"), clock.crosses_day(F.col("clock")).alias("crosses"), clock.minutes(F.concat("clock", F.lit("+1 x"))).alias("plus_one"))


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey, sign(l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)) AS s FROM (SELECT l_suppkey % 10 AS l_suppkey, l_orderkey, CASE l_suppkey % 10 % 3 WHEN 0 THEN l_linenumber * 1000000 WHEN 1 THEN -l_linenumber * 1000000 ELSE 0 END + l_partkey AS l_partkey, l_linenumber, l_extendedprice FROM lineitem)),
g AS (SELECT l_suppkey AS grp, count(DISTINCT l_orderkey) AS journeys, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END)::BIGINT AS up, count(*) AS steps FROM s WHERE s <> 0 GROUP BY 1)
SELECT grp, journeys, up, steps, CASE WHEN up >= steps - up THEN 'up' ELSE 'down' END AS direction FROM g WHERE journeys >= 3 AND greatest(up, steps - up) / steps >= 0.9
""")
def q_direction_vote(t):
    grp, far = F.col("l_suppkey") % 10, F.col("l_linenumber") * 1000000
    place = F.when(grp % 3 == 0, far).when(grp % 3 == 1, -far).otherwise(0) + F.col("l_partkey")
    own = t.lineitem.select(grp.alias("grp"), "l_orderkey", place.alias("l_partkey"), "l_linenumber", "l_extendedprice")
    return sequences.votes(own, ["grp"], "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], "l_partkey", 3, 0.9)


@query("""
SELECT user_id, least(7, count(DISTINCT dayofweek(ts)) + CASE WHEN user_id % 4 = 0 THEN 3 ELSE 0 END)::INT AS weight FROM events GROUP BY 1
""")
def q_service_weights(t):
    by = t.events.groupBy("user_id").agg(F.count_distinct(F.dayofweek("ts")).alias("days"))
    added = F.when(F.col("user_id") % 4 == 0, 3).otherwise(0)
    return by.select("user_id", F.least(F.lit(7), F.col("days") + added).cast("int").alias("weight"))


@query("""
WITH p AS (SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, '-' ORDER BY l_linenumber, l_partkey, l_suppkey) AS pattern FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT pattern, count(*) AS trips FROM p GROUP BY 1
""")
def q_pattern_key(t):
    own = sequences.in_order(t.lineitem.where("l_returnflag <> 'R'"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_suppkey", "items")
    return own.groupBy(F.array_join("items", "-").alias("pattern")).agg(F.count("*").alias("trips"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, event_type FROM events),
a AS (SELECT user_id, min(i) AS i FROM e WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT e.user_id, min(e.i) AS i FROM e JOIN a ON e.user_id = a.user_id AND e.i > a.i WHERE event_type = 'click' GROUP BY 1),
c AS (SELECT DISTINCT e.user_id FROM e JOIN b ON e.user_id = b.user_id AND e.i > b.i WHERE event_type = 'purchase') SELECT user_id FROM c
""")
def q_arrow_subsequence(t):
    items = sequences.in_order(t.events, ["user_id"], ["ts"], "event_type", "items")
    return items.where(text.in_order(F.col("items"), "signup", "click", "purchase")).select("user_id")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1""")
def q_latest_state(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("event_type", at).alias("state"))


@query("""SELECT event_type AS k, arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1""")
def q_last_wins(t):
    last = F.max(F.struct("event_id", "user_id"))
    return t.events.where("event_type <> ''").groupBy(F.col("event_type").alias("k")).agg(last.alias("x")).select("k", "x.event_id", "x.user_id")


@query("""
SELECT user_id, ts::DATE::VARCHAR AS day, coalesce(min(CASE WHEN event_type = 'purchase' THEN strftime(ts, '%H:%M') END), min(CASE WHEN event_type = 'click' THEN strftime(ts, '%H:%M') END), min(strftime(ts, '%H:%M'))) AS departure FROM events GROUP BY 1, 2
""")
def q_departure_fallback(t):
    at = F.date_format("ts", "HH:mm")
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, at))
    return t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.coalesce(first("purchase"), first("click"), F.min(at)).alias("departure"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc_day, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS tokyo_day, ts::DATE <> (ts + INTERVAL 9 HOUR)::DATE AS differs FROM events
""")
def q_tz_shift(t):
    utc, tokyo = F.to_date("ts"), clock.local_day(F.col("ts"), "Asia/Tokyo")
    return t.events.select("event_id", F.date_format(utc, "yyyy-MM-dd").alias("utc_day"), F.date_format(tokyo, "yyyy-MM-dd").alias("tokyo_day"), (utc != tokyo).alias("differs"))


@query(RUNS_SQL + "SELECT user_id, string_agg(event_type || '*' || n, ',' ORDER BY run) AS encoded, sum(n)::BIGINT AS n, (SELECT string_agg(event_type, ',' ORDER BY ts) FROM events e WHERE e.user_id = g.user_id) AS expanded FROM g GROUP BY 1")
def q_rle(t):
    items = sequences.in_order(t.events, ["user_id"], ["ts"], "event_type", "items")
    own = items.withColumn("rle", sequences.run_lengths(F.col("items")))
    return own.select(
        "user_id", F.array_join(F.transform("rle", lambda r: F.concat_ws("*", r["value"], r["n"].cast("string"))), ",").alias("encoded"),
        F.size("items").cast("long").alias("n"), F.array_join(sequences.expanded(F.col("rle")), ",").alias("expanded"),
    )


@query("""
WITH f AS (SELECT *, event_type IN ('purchase', 'click', 'view') AS ok FROM events)
SELECT user_id, CASE WHEN bool_and(ok) THEN 'ridden' WHEN bool_or(ok) THEN 'partly' ELSE 'notRidden' END AS status,
  coalesce(min(CASE WHEN ok THEN event_id END), -1) AS first_id, coalesce(arg_max(event_id, ts) FILTER (ok), -1) AS last_id FROM (SELECT * FROM f) GROUP BY 1
""".replace("min(CASE WHEN ok THEN event_id END)", "arg_min(event_id, ts) FILTER (ok)"))
def q_boarding_default(t):
    own = t.events.withColumn("ok", ~masks.first_rule([(F.col("event_type").isin("purchase", "click", "view"), "boards")], "passes").eqNullSafe("passes"))
    at = F.when(F.col("ok"), F.col("ts"))
    return own.groupBy("user_id").agg(
        F.when(F.bool_and("ok"), "ridden").when(F.bool_or("ok"), "partly").otherwise("notRidden").alias("status"),
        F.coalesce(F.min_by("event_id", at), F.lit(-1)).alias("first_id"), F.coalesce(F.max_by("event_id", at), F.lit(-1)).alias("last_id"),
    )


@query("""
WITH p AS (SELECT s.user_id, s.ts AS a, e.ts AS b FROM events s JOIN events e ON s.user_id = e.user_id AND s.event_type = 'signup' AND e.event_type = 'purchase' AND s.ts < e.ts)
SELECT u.user_id, count(p.a) AS pairs, coalesce(CASE WHEN count(p.a) = 1 THEN strftime(min(a), '%Y-%m-%d %H:%M:%S') END, '-') AS start_at, coalesce(CASE WHEN count(p.a) = 1 THEN strftime(min(b), '%Y-%m-%d %H:%M:%S') END, '-') AS end_at
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON u.user_id = p.user_id GROUP BY 1
""")
def q_embedding_window(t):
    own = sequences.unique_window(t.events.select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type", "signup", "purchase")
    at = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    return own.select("user_id", "pairs", at("start_at").alias("start_at"), at("end_at").alias("end_at"))


@query("""
WITH n AS (SELECT *, lag(event_type) OVER w AS p, lag(ts) OVER w AS pt, lag(event_id) OVER w AS pid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT pid AS from_id, event_id AS to_id, user_id FROM n WHERE p = event_type AND pt::DATE = ts::DATE
""")
def q_continuations(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    own = t.events.select("user_id", "event_id", "event_type", F.to_date("ts").alias("d"), F.lag("event_id").over(w).alias("from_id"), F.lag("event_type").over(w).alias("p"), F.lag(F.to_date("ts")).over(w).alias("pd"))
    return own.where("p = event_type and pd = d").select("from_id", F.col("event_id").alias("to_id"), "user_id")


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, n, CASE WHEN day >= DATE '2024-01-08' AND day < DATE '2024-01-20' AND n >= 300 THEN 'covered' WHEN (day >= DATE '2024-01-08' AND day < DATE '2024-01-20') OR n >= 300 THEN 'partial' ELSE 'none' END AS status FROM d
""")
def q_day_coverage(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    declared = t.spark.sql("select date'2024-01-08' as since, date'2024-01-20' as until")
    return periods.day_coverage(days, "day", declared, 300, "n").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "status")


@query("""
WITH m AS (SELECT event_id, user_id, ts, hour(ts) * 60 + minute(ts) AS m, (epoch(ts::DATE)::BIGINT // 86400) AS d FROM events),
l AS (SELECT *, CASE WHEN m < lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS back FROM m),
s AS (SELECT *, (m + 1440 * sum(back) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS c FROM l)
SELECT event_id, c AS clock FROM s
""")
def q_midnight_carry(t):
    own = t.events.withColumn("m", F.hour("ts") * 60 + F.minute("ts"))
    return sequences.carried(own, ["user_id"], ["ts", "event_id"], "m").select("event_id", F.col("carried").alias("clock"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, json_keys(props)[1] AS keys, len(json_keys(props))::INT AS n_keys, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 0 ELSE len(json_keys(props))::INT END AS unknown FROM events""")
def q_json_scalars(t):
    """Scalars of JSON texts, and how many of their keys the row's type does not allow."""
    keys = F.json_object_keys("props")
    allowed = F.when(F.col("event_type").isin("purchase", "click", "view"), F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get(keys, F.lit(0)).alias("keys"), F.size(keys).alias("n_keys"),
        F.size(F.array_except(keys, allowed)).alias("unknown"),
    )


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def q_window_tumbling(t):
    from waybill.streaming import windows

    own = windows.tumbling(t.events, "1 hour", ["event_type"])
    return own.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM s GROUP BY user_id, s
""")
def q_window_session(t):
    from waybill.streaming import windows

    own = windows.sessions(t.events, "6 hours", ["user_id"])
    return own.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("since"), "n")
