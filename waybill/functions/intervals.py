"""Half-open periods [since, until): a null bound is open, an empty text is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column) -> Column:
    """A bound held as text; the empty text is no bound."""
    return F.nullif(value, F.lit(""))


def in_force(day: Column, since: Column, until: Column) -> Column:
    """Whether a day lies in the period. Without a day, only periods that don't end pass."""
    return F.when(day.isNull(), until.isNull()).otherwise((since.isNull() | (since <= day)) & (until.isNull() | (day < until)))


def first_bounds(*pairs: tuple[Column, Column]) -> tuple[Column, Column]:
    """The bounds of the first pair of which either is given: service, then legacy, then infrastructure."""
    since, until = F.lit(None), F.lit(None)
    for a, b in reversed(pairs):
        given = a.isNotNull() | b.isNotNull()
        since, until = F.when(given, a).otherwise(since), F.when(given, b).otherwise(until)
    return since, until


def applicability(day: Column, since: Column, until: Column, complete: Column) -> Column:
    """``applicable``, ``notApplicable`` or, where the evidence has gaps, ``unknown``; null without a valid day.

    A day outside a known bound is not applicable whatever else is missing.
    """
    return (
        F.when(day.isNull(), None)
        .when((since.isNotNull() & (day < since)) | (until.isNotNull() & (day >= until)), "notApplicable")
        .when(complete, "applicable")
        .otherwise("unknown")
    )


def overlap(since_a: Column, until_a: Column, since_b: Column, until_b: Column) -> Column:
    """Whether two non-empty periods share a day."""
    starts_before = lambda since, until: since.isNull() | until.isNull() | (since < until)
    return starts_before(since_a, until_b) & starts_before(since_b, until_a)
