"""Sequences laid onto others: chains through candidates, embeddings of a list in a list, sections onto stops, walks over edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from waybill.operators import rounds


def cheapest_chain(candidates: DataFrame, journey: str) -> DataFrame:
    """(journey, cost, chain): the cheapest chain of one candidate a layer in which each begins where the one before ends.

    ``candidates`` are (journey, of, layer, id, a, b, cost); a journey has layers 1 to ``of``, and no row where one of them
    is without candidates. Of equal costs the first ids win. The fold keeps one label for each place that a layer ends at, the best
    predecessor's, so its work follows a layer's candidates, and a journey's layers are all that one row holds.
    """
    c = candidates.select(journey, "of", "layer", F.struct("a", "b", "cost", "id").alias("c"))
    layers = c.groupBy(journey, "layer").agg(F.sort_array(F.collect_list("c")).alias("c"), F.max("of").alias("of"))
    journeys = layers.groupBy(journey).agg(F.array_sort(F.collect_list(F.struct("layer", "c"))).alias("layers"), F.max("of").alias("of"))
    whole = F.col("of") == F.size("layers")

    def labels(of: Column) -> Column:
        """Of labels that end at one place the least stays: one look at the labels for each place."""
        ends = F.array_compact(F.array_distinct(F.transform(of, lambda x: x["b"])))
        return F.transform(ends, lambda b: F.array_min(F.filter(of, lambda x: x["b"] == b)))

    def step(state: Column, layer: Column) -> Column:
        def longer(c: Column) -> Column:
            ways = F.transform(F.filter(state, lambda s: s["b"] == c["a"]), lambda s: F.struct((s["cost"] + c["cost"]).alias("cost"), F.array_append(s["chain"], c["id"]).alias("chain"), c["b"].alias("b")))
            return F.array_min(ways)

        grown = F.transform(layer["c"], longer)
        return F.get(F.transform(F.array(grown), labels), F.lit(0))

    first = F.transform(F.get("layers", F.lit(0))["c"], lambda c: F.struct(c["cost"].alias("cost"), F.array(c["id"]).alias("chain"), c["b"].alias("b")))
    state = F.get(F.transform(F.array(first), labels), F.lit(0))
    done = journeys.where(whole).select(journey, F.array_min(F.aggregate(F.slice("layers", F.lit(2), F.size("layers")), state, step)).alias("best"))
    return done.where("best is not null").select(journey, "best.cost", "best.chain")


def embedded(pattern: Column, items: Column) -> Column:
    """struct(n, places): in how many ways (0, 1, or 2 for several) the pattern is a subsequence of the items, and the places, from 0, of the only one.

    One pass over the items keeps, for each prefix of the pattern, whether it has no, one or several embeddings so far and the
    places of the only one: time is the product of the lengths, however many embeddings there are. Null items match nothing; an
    empty pattern has one embedding.
    """
    none = F.array().cast("array<int>")
    start = F.transform(F.sequence(F.lit(0), F.size(pattern)), lambda j: F.struct(F.when(j == 0, 1).otherwise(0).alias("n"), none.alias("places")))

    def step(state: Column, x: Column) -> Column:
        def prefix(own: Column, j: Column) -> Column:
            shorter = F.get(state["ways"], j - 1)
            fits = F.coalesce((F.get(pattern, j - 1) == x) & (shorter["n"] > 0), F.lit(False))
            places = F.when(own["n"] == 0, F.array_append(shorter["places"], state["i"])).otherwise(own["places"])
            return F.when(fits, F.struct(F.least(F.lit(2), own["n"] + shorter["n"]).alias("n"), places.alias("places"))).otherwise(own)

        return F.struct((state["i"] + 1).alias("i"), F.transform(state["ways"], prefix).alias("ways"))

    def last(state: Column) -> Column:
        whole = F.element_at(state["ways"], -1)
        return F.struct(whole["n"].alias("n"), F.when(whole["n"] == 1, whole["places"]).alias("places"))

    return F.aggregate(items, F.struct(F.lit(0).alias("i"), start.alias("ways")), step, last)


def same_station(code: Column, name: Column, other_code: Column, other_name: Column) -> Column:
    """Codes decide where both have one, else names; a missing or empty name matches nothing."""
    full = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(full(code) & full(other_code), code == other_code).otherwise(full(name) & full(other_name) & F.coalesce(name == other_name, F.lit(False)))


def section_bounds(stops: Column, sections: Column) -> Column:
    """For each stop the number of sections before it, if the sections are one chain through all stops in order; else null.

    ``stops`` are structs of code and name, ``sections`` of from_code, from_name, to_code, to_name. Sections as many as
    steps need only fit their own stops; otherwise each must begin where the one before ends, and an inner stop is at the
    first section's end after the stop before that it matches.
    """
    n, m = F.size(stops), F.size(sections)

    def meets(section: Column, side: str, stop: Column) -> Column:
        return same_station(section[f"{side}_code"], section[f"{side}_name"], stop["code"], stop["name"])

    def named(s: Column) -> Column:
        some = lambda side: F.coalesce(F.length(s[f"{side}_code"]) > 0, F.lit(False)) | F.coalesce(F.length(s[f"{side}_name"]) > 0, F.lit(False))
        return some("from") & some("to")

    paired = (m == n - 1) & F.forall(F.transform(sections, lambda s, i: meets(s, "from", F.get(stops, i)) & meets(s, "to", F.get(stops, i + 1))), lambda x: x)
    follows = F.forall(
        F.transform(sections, lambda s, i: (i == 0) | same_station(F.get(sections, i - 1)["to_code"], F.get(sections, i - 1)["to_name"], s["from_code"], s["from_name"])), lambda x: x
    ) & F.forall(sections, named)
    ends = meets(F.get(sections, F.lit(0)), "from", F.get(stops, F.lit(0))) & meets(F.element_at(sections, -1), "to", F.element_at(stops, -1))

    def step(bounds: Column, at: Column) -> Column:
        place, section = at["i"], at["s"]
        waiting = (F.size(bounds) < n - 1) & (place < m) & meets(section, "to", F.get(stops, F.size(bounds)))
        return F.when(waiting, F.array_append(bounds, place)).otherwise(bounds)

    inner = F.aggregate(F.transform(sections, lambda s, i: F.struct((i + 1).alias("i"), s.alias("s"))), F.array(F.lit(0)), step)
    found = F.when(F.size(inner) == n - 1, F.array_append(inner, m))
    usable = (n >= 2) & (m >= 1)
    return F.when(usable, F.when(ends & paired, F.sequence(F.lit(0), m)).otherwise(F.when(ends & follows, found)))


def walked(points: list, known: dict[tuple, tuple[float, int]], metres: Callable[[object, object], float], bridge: float) -> Iterator[tuple[str, object, object, float, int]]:
    """(kind, from, to, m, mask) along one journey's points: ``edge`` for what is on the network and ``gap`` for what joins it.

    The walk looks for an edge from the last place that was on the network, so points set between an edge's ends don't
    break it, then for one from the point before. Steps that find none add up; they become a gap with the mask of the
    edge that they reach, or at the journey's end of the edge that they left, and one without a mask when longer than
    ``bridge``. Gaps without length are left out.
    """
    on = lambda a, b: known.get((min(a, b), max(a, b)))
    base, mask, open_m = 0, 0, 0.0
    for i in range(1, len(points)):
        if points[i] == points[base]:
            continue
        near = next(((k, e) for k in (base, i - 1) if points[k] != points[i] and (e := on(points[k], points[i]))), None)
        if near:
            k, (m, found) = near
            if k != base and open_m > 0:
                yield "gap", points[base], points[k], open_m, found
            yield "edge", points[k], points[i], m, found
            base, mask, open_m = i, found, 0.0
            continue
        open_m += metres(points[i - 1], points[i])
        if open_m > bridge or i == len(points) - 1:
            if open_m > 0:
                yield "gap", points[base], points[i], open_m, 0 if open_m > bridge else mask
            base, mask, open_m = i, 0 if open_m > bridge else mask, 0.0


def edge_walk(points: DataFrame, edges: DataFrame, journey: str, metres: Callable[[object, object], float], bridge: float, few: int = 200_000) -> DataFrame:
    """(journey, seq, kind, a, b, m, mask): ``walked`` for each journey of ``points`` (journey, pos, place) over ``edges`` (a, b, m, mask), a <= b.

    A journey meets only the edges both of whose ends are among its places: the pairs of its places look them up, where they stand if
    edges are ``few`` and so broadcast, else by a shuffle of the pairs. Its points and those edges are one row, and rows go to Python in Arrow batches. Journeys of one point have no rows; points without a place are passed over.
    """
    own = points.where(F.col("place").isNotNull()).select(journey, "pos", "place")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    lists = own.groupBy(journey).agg(F.array_sort(F.collect_list(F.struct("pos", "place")))["place"].alias("points"))
    edges = rounds.settled(edges.select("a", "b", "m", "mask"))
    ends = lists.select(journey, F.array_distinct("points").alias("_p")).select(journey, "_p", F.explode("_p").alias("a"))
    pairs = ends.select(journey, "a", F.explode(F.filter("_p", lambda x: x > F.col("a"))).alias("b"))
    known = pairs.join(F.broadcast(edges) if edges.count() <= few else edges, ["a", "b"])
    lists = lists.join(known.groupBy(journey).agg(F.collect_list(F.struct("a", "b", "m", "mask")).alias("known")), journey, "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, places, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by = {(e["a"], e["b"]): (e["m"], e["mask"]) for e in found or ()}
                rows += [(who, k, *row) for k, row in enumerate(walked(places, by, metres, bridge), 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.record_batch([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    schema = T.StructType.fromDDL(f"{journey} {kinds[journey]}, seq int, kind string, a {kinds['place']}, b {kinds['place']}, m double, mask int")
    return lists.select(journey, "points", "known").mapInArrow(walk, schema)


def ride_sections(stops: Column, sections: Column) -> Column:
    """A journey's sections to keep: the recorded ones if they are one chain through all its stops, else one a pair of stops.

    Structs as in ``section_bounds``, from_code, from_name, to_code, to_name, as texts; each comes back with ``recorded``, its
    place among the recorded ones. For a pair the section in its place comes first, then the first that fits it; where
    none does, one is made of the stops' own codes and names, and recorded is null. Fewer than two stops have none.
    """
    sides = ("from_code", "from_name", "to_code", "to_name")
    known = F.transform(sections, lambda s, i: F.struct(*[s[c].alias(c) for c in sides], i.alias("recorded")))

    def fits(s: Column, a: Column, b: Column) -> Column:
        return same_station(s["from_code"], s["from_name"], a["code"], a["name"]) & same_station(s["to_code"], s["to_name"], b["code"], b["name"])

    def one(b: Column, i: Column) -> Column:
        a = F.get(stops, i)
        made = F.struct(a["code"].alias("from_code"), a["name"].alias("from_name"), b["code"].alias("to_code"), b["name"].alias("to_name"), F.lit(None).cast("int").alias("recorded"))
        in_place = F.filter(known, lambda s: (s["recorded"] == i) & fits(s, a, b))
        return F.coalesce(F.get(in_place, F.lit(0)), F.get(F.filter(known, lambda s: fits(s, a, b)), F.lit(0)), made)

    pairs = F.transform(F.slice(stops, F.lit(2), F.greatest(F.size(stops) - 1, F.lit(0))), one)
    return F.when(section_bounds(stops, sections).isNotNull(), known).otherwise(pairs)
