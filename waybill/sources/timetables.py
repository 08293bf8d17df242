"""Published train timetables, imported through reviewed mappings: trips that pass every rule, and the others with their reasons."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators import rounds

_SCHEMA = ", ".join(
    [
        "`@type` string, `owl:sameAs` string, `odpt:railway` string, `odpt:operator` string, `odpt:trainType` string, `odpt:calendar` string",
        "`odpt:trainNumber` string, `odpt:previousTrain` string, `odpt:nextTrain` string",
        "`odpt:trainTimetableObject` array<struct<`odpt:arrivalStation`: string, `odpt:departureStation`: string, `odpt:arrivalTime`: string, `odpt:departureTime`: string>>",
    ]
)
_DAY = 86_400


class Mapping(NamedTuple):
    """Reviewed identities. railways (id, operator_name, line_ids), operators (id, operator_name), train_types (id, display_name,
    train_type), calendars (id, dates), stations (id, code, name), and the known lines (id, operator, codes). An id that
    comes twice is ambiguous, and so unmapped."""

    railways: DataFrame
    operators: DataFrame
    train_types: DataFrame
    calendars: DataFrame
    stations: DataFrame
    lines: DataFrame


class Imported(NamedTuple):
    """trips (id, train_number, train_type, operator_name, line_ids, service_dates, previous_ids, next_ids, stops), lines (line_id,
    operator_name, train_type, display_name: what the trips give evidence of), rejects (row, id, reasons)."""

    trips: DataFrame
    lines: DataFrame
    rejects: DataFrame


def seconds(text: Column, previous: Column) -> Column:
    """struct (at, fault): seconds of a service day of ``H:MM`` or ``H:MM:SS`` after ``previous`` (-1 at the start).

    Hours up to 47 are taken as they stand; below 24 they belong to the day that ``previous`` has reached. A step back is
    midnight only from 18 o'clock or later to before 6. Null has neither; a fault has no time.
    """
    part = lambda k: F.coalesce(F.try_element_at(F.split(text, ":"), F.lit(k)).try_cast("int"), F.lit(0))
    hour = part(1)
    plain = (hour * 3600 + part(2) * 60 + part(3)).cast("long")
    own = plain + F.when((hour < 24) & (previous >= _DAY), F.floor(previous / _DAY) * _DAY).otherwise(0)
    back = own < previous
    midnight = (hour < 6) & (previous % _DAY >= 18 * 3600)
    at = own + F.when(back & midnight, _DAY).otherwise(0)
    fault = (
        F.when(~text.rlike(r"^[0-9]{1,9}:[0-9]{1,9}(:[0-9]{1,9})?$"), "time of another form")
        .when((hour > 47) | (part(2) > 59) | (part(3) > 59), "time beyond the service day")
        .when(back & ~midnight, "time goes back")
        .when(at >= 2 * _DAY, "second midnight")
    )
    given = text.isNotNull()
    return F.struct(F.when(given & fault.isNull(), at).cast("long").alias("at"), F.when(given, fault).alias("fault"))


def timed(calls: Column) -> Column:
    """struct (previous, calls array of (arrival, departure), fault) of calls (arrival, departure) in order; the first fault counts."""
    start = F.struct(F.lit(-1).cast("long").alias("previous"), F.array().cast("array<struct<arrival: bigint, departure: bigint>>").alias("calls"), F.lit(None).cast("string").alias("fault"))

    def step(state, call):
        arrival = seconds(call["arrival"], state["previous"])
        departure = seconds(call["departure"], F.coalesce(arrival["at"], state["previous"]))
        none = F.when(call["arrival"].isNull() & call["departure"].isNull(), "call without a time")
        both = F.struct(arrival["at"].alias("arrival"), departure["at"].alias("departure"))
        return F.struct(
            F.coalesce(departure["at"], arrival["at"], state["previous"]).alias("previous"),
            F.concat(state["calls"], F.array(both)).alias("calls"),
            F.coalesce(state["fault"], arrival["fault"], departure["fault"], none).alias("fault"),
        )

    return F.aggregate(calls, start, step)


def _mapped(frame: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    once = frame.groupBy("id").agg(F.count("*").alias("_n"), *[F.first(c).alias(f"{prefix}_{c}") for c in columns]).where("_n = 1 and id is not null")
    return once.drop("_n").withColumnRenamed("id", f"{prefix}_id").withColumn(f"{prefix}_is", F.lit(True))


def _references(text: Column) -> Column:
    """Names given as one text or as a list of them; null if neither."""
    listed = F.from_json(text, "array<string>")
    right = F.when(text.startswith("["), F.when(listed.isNotNull() & ~F.exists(listed, lambda x: x.isNull() | (x == "")), listed))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(right, F.when(~text.rlike(r"^[\[{]") & (text != ""), F.array(text))))


def imported(spark: SparkSession, path: str, mapping: Mapping, valid_from: str, valid_until: str) -> Imported:
    """The trips of JSON lists of timetables at ``path``, whose dates lie from ``valid_from`` to before ``valid_until``.

    A row with any fault is refused with all its reasons, in alphabetic order; the rest is imported. An identity that comes
    more than once is refused in all its rows.
    """
    if not valid_from < valid_until:
        raise ValueError("the validity ends before it begins")
    raw = spark.read.schema(_SCHEMA).json(path, multiLine=True)
    names = ["kind", "id", "railway", "operator", "type", "calendar", "number", "previous", "next", "calls"]
    rows = rounds.settled(raw.select(F.expr("uuid()").alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)]))
    joined = rows
    for own, prefix, frame, columns in (
        ("railway", "r", mapping.railways, ["operator_name", "line_ids"]),
        ("operator", "o", mapping.operators, ["operator_name"]),
        ("type", "t", mapping.train_types, ["display_name", "train_type"]),
        ("calendar", "c", mapping.calendars, ["dates"]),
    ):
        joined = joined.join(_mapped(frame, columns, prefix), F.col(own) == F.col(f"{prefix}_id"), "left")
    repeats = rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("_twice"))
    joined = rounds.settled(joined.join(repeats, F.col("id") == F.col("_twice"), "left"))

    named = joined.select("row", "o_operator_name", F.explode("r_line_ids").alias("line_id"))
    lines = _mapped(mapping.lines, ["operator", "codes"], "l")
    on_lines = named.join(lines, F.col("line_id") == F.col("l_id"), "left").groupBy("row").agg(
        F.bool_or(F.col("l_is").isNull() | ~F.col("l_operator").eqNullSafe(F.col("o_operator_name"))).alias("_line_fault"),
        F.flatten(F.collect_list("l_codes")).alias("_codes"),
    )
    arrives, departs = F.col("call.`odpt:arrivalStation`"), F.col("call.`odpt:departureStation`")
    calls = joined.select("row", F.posexplode("calls").alias("place", "call"))
    calls = calls.select("row", "place", F.coalesce(F.nullif(arrives, F.lit("")), departs).alias("station"), (arrives != departs) & (arrives != "") & (departs != ""), F.col("call.`odpt:arrivalTime`").alias("arrival"), F.col("call.`odpt:departureTime`").alias("departure"))
    calls = calls.toDF("row", "place", "station", "_disagree", "arrival", "departure")
    calls = calls.join(_mapped(mapping.stations, ["code", "name"], "s"), F.col("station") == F.col("s_id"), "left")
    calls = calls.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "s_code", "s_name", "arrival", "departure"))).alias("_calls"),
        F.bool_or(F.coalesce("_disagree", F.lit(False))).alias("_disagree"),
        F.bool_or(F.col("s_is").isNull()).alias("_unmapped"),
        F.collect_set("s_code").alias("_stations"),
    )
    joined = joined.join(on_lines, "row", "left").join(calls, "row", "left").withColumn("_timed", timed(F.coalesce("_calls", F.array().cast("array<struct<place: int, s_code: string, s_name: string, arrival: string, departure: string>>"))))
    fault = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
    ids = F.col("r_line_ids")
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                fault(~F.col("kind").eqNullSafe(F.lit("odpt:TrainTimetable")), "not a train timetable"),
                fault(F.col("id").isNull() | (F.col("id") == "") | F.col("_twice").isNotNull(), "identity missing or repeated"),
                fault(F.col("r_is").isNull(), "railway unmapped"),
                fault(F.col("r_is") & (ids.isNull() | (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) < F.size(ids))), "lines of the railway unclear"),
                fault(F.col("o_is").isNull(), "operator unmapped"),
                fault(F.col("o_is") & F.col("r_is") & ~F.col("o_operator_name").eqNullSafe(F.col("r_operator_name")), "operator is not the railway's"),
                fault(F.col("t_is").isNull(), "train type unmapped"),
                fault(F.col("c_is").isNull(), "calendar unmapped"),
                fault(F.col("c_is") & (F.coalesce(F.size("c_dates"), F.lit(0)) < 1), "calendar without dates"),
                fault(F.exists("c_dates", lambda d: d.isNull() | d.try_cast("date").isNull() | (d < valid_from) | (d >= valid_until)), "date beyond the validity"),
                fault(F.col("_line_fault"), "line unknown or of another operator"),
                fault(F.col("_disagree"), "stations of a call disagree"),
                fault(F.col("_unmapped"), "station unmapped"),
                fault(F.size(F.array_except("_stations", F.coalesce("_codes", F.array().cast("array<string>")))) > 0, "station beyond the lines"),
                F.col("_timed.fault"),
                fault(F.size("_timed.calls") < 2, "fewer than two calls"),
                fault(_references(F.col("previous")).isNull() | _references(F.col("next")).isNull(), "neighbour trains of another form"),
            )
        )
    )
    judged = rounds.settled(joined.withColumn("reasons", reasons))
    good = judged.where("size(reasons) = 0")
    stops = F.zip_with("_calls", "_timed.calls", lambda c, t: F.struct(c["s_code"].alias("code"), c["s_name"].alias("name"), t["arrival"].alias("arrival"), t["departure"].alias("departure")))
    trips = good.select(
        "id", F.coalesce("number", F.lit("")).alias("train_number"), F.col("t_train_type").alias("train_type"), F.col("o_operator_name").alias("operator_name"), ids.alias("line_ids"),
        F.array_sort(F.array_distinct("c_dates")).alias("service_dates"), _references(F.col("previous")).alias("previous_ids"), _references(F.col("next")).alias("next_ids"), stops.alias("stops"),
    )
    evidence = good.select(F.explode(ids).alias("line_id"), F.col("o_operator_name").alias("operator_name"), F.col("t_train_type").alias("train_type"), F.col("t_display_name").alias("display_name")).distinct()
    return Imported(trips, evidence, judged.where("size(reasons) > 0").select("row", "id", "reasons"))
