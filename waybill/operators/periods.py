"""Dated facts: as-of joins, overlaps, splits, calendars and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions import intervals


def as_of(events: DataFrame, opens: Column, keys: list[str], at: str, name: str) -> DataFrame:
    """Each row that opens nothing with the ``at`` of the latest opening at or before it, null before the first.

    One sort by key and time in place of a range join: a period ends where the next one begins.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_opens", opens).withColumn(name, F.last(F.when(F.col("_opens"), F.col(at)), ignorenulls=True).over(w)).where("not _opens").drop("_opens")


def overlapping(df: DataFrame, keys: list[str], id_: str, since: str, until: str, days: int) -> DataFrame:
    """(keys, a, b) of overlapping periods of a key, a < b.

    Periods meet in the buckets of ``days`` days that they touch, so a key with very many periods is compared bucket by
    bucket; a pair is taken in the bucket where the later one begins.
    """
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    own = df.where(F.col(since) < F.col(until)).select(*keys, F.col(id_).alias("id"), F.col(since).alias("s"), F.col(until).alias("u"))
    in_buckets = own.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s")), bucket(F.date_sub("u", 1)))))
    x, y = in_buckets.alias("x"), in_buckets.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id"))
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    meets = intervals.overlap(F.col("x.s"), F.col("x.u"), F.col("y.s"), F.col("y.u")) & (bucket(F.greatest("x.s", "y.s")) == F.col("x.bucket"))
    return x.join(y, same & meets).select(*[F.col(f"x.{k}") for k in keys], F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def split(periods: DataFrame, keys: list[str], since: str, until: str, low: str, high: str) -> DataFrame:
    """(keys, since, until, kind): the range [low, high) of each key cut into pieces that periods cover and gaps that none does."""
    start, end = F.greatest(F.col(since), F.lit(low).cast("date")), F.least(F.col(until), F.lit(high).cast("date"))
    own = periods.select(*keys, start.alias("s"), end.alias("u")).where("s < u")
    w = Window.partitionBy(*keys).orderBy("s", "u")
    covered = F.max("u").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = own.withColumn("c", F.coalesce(covered, F.lit(low).cast("date"))).withColumn("last", F.lead("s").over(w).isNull()).withColumn("top", F.greatest("u", "c"))
    high_ = F.lit(high).cast("date")
    rows = F.array(
        F.when(F.col("c") < F.col("s"), F.struct(F.col("c").alias("since"), F.col("s").alias("until"), F.lit("gap").alias("kind"))),
        F.when(F.greatest("c", "s") < F.col("u"), F.struct(F.greatest("c", "s").alias("since"), F.col("u").alias("until"), F.lit("piece").alias("kind"))),
        F.when(F.col("last") & (F.col("top") < high_), F.struct(F.col("top").alias("since"), high_.alias("until"), F.lit("gap").alias("kind"))),
    )
    return cut.select(*keys, F.inline(F.array_compact(rows)))


def service_days(trips: DataFrame, calendars: DataFrame, exceptions: DataFrame, versions: DataFrame, low: str, high: str, verified_holidays: DataFrame | None = None) -> DataFrame:
    """(trip_id, service_date) of every day from low to high, high excluded, on which a trip runs.

    The version's range decides first. Then an exception of the calendar, even outside the calendar's own range; then that
    range; then, for calendars that treat holidays as Sundays, a holiday of a verified year; then the weekday's flag.
    A calendar that needs an unverified year has no days in it. Of several exceptions of one day, ``remove`` holds.
    Each calendar is expanded to the days of its own range before trips are joined, and ``add`` exceptions bring theirs.
    """
    flags = F.array(*[F.col(d) for d in ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")])
    one = exceptions.select("calendar_id", F.col("service_date").cast("date").alias("service_date"), "exception_type")
    one = one.where(F.col("service_date").between(low, F.date_sub(F.lit(high).cast("date"), 1))).groupBy("calendar_id", "service_date").agg(F.max("exception_type").alias("exception_type"))
    first = F.greatest(F.coalesce(intervals.bound(F.col("valid_from")).cast("date"), F.lit(low).cast("date")), F.lit(low).cast("date"))
    last = F.date_sub(F.least(F.coalesce(intervals.bound(F.col("valid_until")).cast("date"), F.lit(high).cast("date")), F.lit(high).cast("date")), 1)
    own_days = calendars.where(first <= last).select("calendar_id", F.explode(F.sequence(first, last)).alias("service_date"))
    days = own_days.join(one, ["calendar_id", "service_date"], "full")
    grid = days.join(calendars, "calendar_id")
    if verified_holidays is None:
        grid = grid.withColumn("_holiday", F.lit(False)).withColumn("_verified", F.lit(True))
    else:
        # year, service_date (null for a year without holidays): rows of verified years alone
        h = verified_holidays.select(F.col("service_date").cast("date").alias("service_date")).where("service_date is not null").distinct().withColumn("_holiday", F.lit(True))
        y = verified_holidays.select(F.col("year").alias("_year")).distinct().withColumn("_verified", F.lit(True))
        grid = grid.join(h, "service_date", "left").withColumn("_year", F.year("service_date")).join(y, "_year", "left")
    as_sunday = F.col("holiday_policy") == "treat_as_sunday" if "holiday_policy" in calendars.columns else F.lit(False)
    holiday = as_sunday & F.coalesce("_holiday", F.lit(False))
    in_range = intervals.in_force(F.col("service_date"), intervals.bound(F.col("valid_from")).cast("date"), intervals.bound(F.col("valid_until")).cast("date"))
    flag = F.when(holiday, F.col("sunday")).otherwise(F.get(flags, F.dayofweek("service_date") - 1)) == 1
    runs = (
        F.when(F.col("exception_type") == "remove", False)
        .when(F.col("exception_type") == "add", True)
        .when(~in_range, False)
        .when(as_sunday & F.col("_verified").isNull(), False)
        .otherwise(flag)
    )
    active = grid.where(runs).select("calendar_id", "service_date")
    v = versions.select("timetable_version_id", intervals.bound(F.col("effective_from")).cast("date").alias("_f"), intervals.bound(F.col("effective_until")).cast("date").alias("_u"))
    own = trips.select("trip_id", "timetable_version_id", "calendar_id").join(v, "timetable_version_id")
    return own.join(active, "calendar_id").where(intervals.in_force(F.col("service_date"), F.col("_f"), F.col("_u"))).select("trip_id", "service_date")


def overridden(base: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with each column's override where one is given; ``<column>_present`` = 1 makes a null override clear it."""
    o = overrides.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"{c}_present").alias(f"_{c}_present") for c in columns])
    joined = base.join(o, keys, "left")
    new = {c: F.when(F.col(f"_{c}_present") == 1, F.col(f"_{c}")).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) for c in columns}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def occurrences(days: DataFrame, calls: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Calls of each trip and day, keyed ``trip@day``, with the overrides of that day."""
    own = days.join(calls, "trip_id").withColumn("occurrence_id", F.concat_ws("@", "trip_id", F.date_format("service_date", "yyyy-MM-dd")))
    return overridden(own, overrides, ["trip_id", "service_date", "stop_sequence"], columns)


def day_coverage(days: DataFrame, day: str, declared: DataFrame, least: int, n: str) -> DataFrame:
    """``covered`` where a declared interval holds and enough rows are, ``partial`` where one of both, else ``none``."""
    d = F.broadcast(declared.select(F.col("since").alias("_s"), F.col("until").alias("_u")))
    inside = days.join(d, intervals.in_force(F.col(day), F.col("_s"), F.col("_u")), "left").groupBy(day, n).agg(F.max(F.col("_s").isNotNull() | F.col("_u").isNotNull()).alias("inside"))
    enough = F.col(n) >= least
    return inside.select(day, n, F.when(F.col("inside") & enough, "covered").when(F.col("inside") | enough, "partial").otherwise("none").alias("status"))
