"""Days as text and clocks past midnight. Three validators coexist on purpose: lenient, strict and editor's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A clock's day offset is at most a leap year.
MOST_DAYS = 366
UNDATED = "undated"


def lenient_day(text: Column) -> Column:
    """YYYY-MM-DD with month 1-12 and day 1-31; a 31st of February passes."""
    month, day = F.substring(text, 6, 2).try_cast("int"), F.substring(text, 9, 2).try_cast("int")
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & month.between(1, 12) & day.between(1, 31), F.lit(False))


def strict_day(text: Column) -> Column:
    """YYYY-MM-DD that is in the calendar."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def normal_day(text: Column) -> Column:
    """Trimmed, with slashes as hyphens; null unless the lenient rule holds."""
    plain = F.regexp_replace(F.trim(text), "/", "-")
    return F.when(lenient_day(plain), plain)


def day_in_id(id_: Column) -> Column:
    """The day that eight digits, between no other digits, spell in an id."""
    digits = F.regexp_extract(id_, r"(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)", 1)
    return normal_day(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def journey_day(explicit: Column, fallback: Column, id_: Column) -> Column:
    return F.coalesce(normal_day(explicit), normal_day(fallback), day_in_id(id_), F.lit(UNDATED))


def shift_day(text: Column, days: Column) -> Column:
    """The day so many days later; 0 gives the text as it is, and a 30th of February rolls forward."""
    first = F.make_date(F.substring(text, 1, 4).cast("int"), F.substring(text, 6, 2).cast("int"), F.lit(1))
    rolled = F.date_add(first, F.substring(text, 9, 2).cast("int") - 1 + days)
    return F.when(days == 0, text).when(lenient_day(text), F.date_format(rolled, "yyyy-MM-dd"))


def minutes(text: Column) -> Column:
    """Minutes of ``H:MM`` with hours past 24 and an optional ``+N`` days; what follows is ignored; null if it is no clock."""
    pattern = r"^\s*([0-9]{1,2}):([0-9]{2})(?:\+([0-9]+))?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    days = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0))
    usable = text.rlike(pattern) & (part(2).try_cast("int") < 60) & (days <= MOST_DAYS) & (F.length(part(3)) <= 4)
    return F.when(usable, part(1).cast("int") * 60 + part(2).cast("int") + days * 1440)


def crosses_day(text: Column) -> Column:
    return F.coalesce(text.contains("+") | (minutes(text) >= 1440), F.lit(False))


def clock_text(seconds: Column) -> Column:
    """``HH:MM`` that goes on past 24."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60)


def canonical_clock(total: Column) -> Column:
    """Text of minutes: hours up to 99, beyond them the hour of the day and ``+N``."""
    hours, rest = F.floor(total / 60), total % 60
    return F.when(hours <= 99, F.format_string("%d:%02d", hours, rest)).otherwise(F.format_string("%d:%02d+%d", hours % 24, rest, F.floor(hours / 24)))


def editor_minutes(text: Column) -> Column:
    """``H:MM``, ``HMM`` or ``HHMM`` with full-width digits and signs folded, hour 0-99, optional ``+N``; null otherwise."""
    plain = F.translate(F.trim(text), "０１２３４５６７８９：＋", "0123456789:+")
    pattern = r"^([0-9]{1,2}):?([0-9]{2})(?:\+([0-9]{1,3}))?$"
    part = lambda k: F.regexp_extract(plain, pattern, k)
    days = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(plain.rlike(pattern) & (part(2).try_cast("int") < 60) & (days <= MOST_DAYS), part(1).cast("int") * 60 + part(2).cast("int") + days * 1440)


def ride_minutes(start: Column, end: Column) -> Column:
    """Minutes between two clocks of a day; an end before the start is the next day's."""
    return F.when(end < start, end + 1440).otherwise(end) - start


def era_day(text: Column) -> Column:
    """The day of an era date such as 平3.4.1: Heisei years count from 1988, Reiwa years from 2018, 元 is 1. Null if unknown."""
    pattern = r"^(平|令)[^0-9元]*([0-9]+|元)[^0-9]+([0-9]+)[^0-9]+([0-9]+)"
    era, year = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    base = F.when(era == "平", 1988).when(era == "令", 2018)
    number = F.when(year == "元", 1).otherwise(year.try_cast("int"))
    month, day = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (3, 4))
    return F.when(text.rlike(pattern), F.format_string("%04d-%02d-%02d", base + number, month, day).try_cast("date"))


def local_day(instant: Column, zone: str) -> Column:
    """The civil day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))
