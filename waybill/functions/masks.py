"""Classes of things as ordered rules and as bit masks that overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(rules: list[tuple[int, Column]]) -> Column:
    """The bits of all rules that hold; categories overlap."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule, bit).otherwise(0) for bit, rule in rules])


def has(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


def exclusive(bits: Column, order: list[tuple[int, str]], rest: str) -> Column:
    """The first named bit of the order that is set; each thing has one bucket."""
    out = F.lit(rest)
    for bit, name in reversed(order):
        out = F.when(has(bits, bit), name).otherwise(out)
    return out


def first_rule(rules: list[tuple[Column, str]], rest: str | None = None) -> Column:
    """The name of the first rule that holds, in the order given."""
    out = F.lit(rest)
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def is_rail_route(route_type: Column) -> Column:
    """Route types of rail: the basic ones and the extended ranges."""
    n = route_type.try_cast("int")
    return F.coalesce(n.isin(0, 1, 2, 5, 7, 12) | n.between(100, 117) | n.between(400, 405) | n.between(900, 906) | (n == 1400), F.lit(False))


def route_kind(route_type: Column) -> Column:
    """The coarse kind of a route type; trams are asked for first, and what is no number is rail."""
    n = route_type.try_cast("int")
    rules = [
        ((n == 0) | n.between(900, 906), "tram"),
        ((n == 1) | n.between(400, 405), "metro"),
        ((n == 2) | n.between(100, 117), "rail"),
        (n == 5, "cable"),
        ((n == 7) | (n == 1400), "funicular"),
        (n == 12, "monorail"),
    ]
    return first_rule(rules, "rail")
