"""A reviewed history laid over a network: stamps on what stands today, rows of what is gone, and a report of what met nothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Applied(NamedTuple):
    """features: the base rows, stamped, and the added ones. report (history_id, matched): each stamp with its number of rows."""

    features: DataFrame
    report: DataFrame


def applied(base: DataFrame, stamps: DataFrame, added: DataFrame) -> Applied:
    """``base`` and ``added`` are (id, layer, line_name, operator, station_name, x0, y0, x1, y1, since, until, kind, history_id), where
    layer is sections or stations and the box is null without points. ``stamps`` are (place, history_id, line_name, operator,
    station_name, layers, x0, y0, x1, y1, since, until); their bounds are resolved already.

    A stamp meets features of its line and operator whose box lies within its own, in the layers that it names (all if none), at
    its station if it names one. Of several, the last by place that has a bound sets it. A section that gets a beginning
    and is current becomes relocatedNew, and without an own history id it takes that of the first such stamp. An added
    section is relocatedOld if its id with .new- in place of .old- is that of a stamp, else historical.

    Stamps are few for a line and go to the features as one list, so features are neither multiplied nor regrouped.
    """
    columns = ["id", "layer", "line_name", "operator", "station_name", "x0", "y0", "x1", "y1", "since", "until", "kind", "history_id"]
    own = ["place", "history_id", "station_name", "layers", "x0", "y0", "x1", "y1", "since", "until"]
    lists = stamps.where("line_name is not null and operator is not null").groupBy("line_name", "operator").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("_stamps"))

    def meets(s):
        layer = s["layers"].isNull() | (F.size(s["layers"]) == 0) | F.array_contains(s["layers"], F.col("layer"))
        station = s["station_name"].isNull() | s["station_name"].eqNullSafe(F.col("station_name"))
        inside = (F.col("x0") >= s["x0"]) & (F.col("y0") >= s["y0"]) & (F.col("x1") <= s["x1"]) & (F.col("y1") <= s["y1"])
        return F.coalesce(layer & station & inside, F.lit(False))

    met = base.select(*columns).join(lists, ["line_name", "operator"], "left").withColumn("_met", F.filter(F.coalesce("_stamps", F.array().cast(lists.schema["_stamps"].dataType)), meets))
    begins, ends = F.filter("_met", lambda s: s["since"].isNotNull()), F.filter("_met", lambda s: s["until"].isNotNull())
    section, begun = F.col("layer") == "sections", F.size("_begins") > 0
    met = met.withColumn("_begins", begins).withColumn("_ends", ends)
    new = {
        "since": F.coalesce(F.try_element_at("_begins", F.lit(-1))["since"], F.col("since")),
        "until": F.coalesce(F.try_element_at("_ends", F.lit(-1))["until"], F.col("until")),
        "kind": F.when(section & begun & (F.col("kind") == "current"), "relocatedNew").otherwise(F.col("kind")),
        "history_id": F.coalesce("history_id", F.when(section, F.get("_begins", F.lit(0))["history_id"])),
    }
    stamped = met.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
    names = stamps.select(F.col("history_id").alias("_new")).distinct()
    renamed = F.replace(F.col("history_id"), F.lit(".old-"), F.lit(".new-"))
    more = added.select(*columns).join(names, (renamed == F.col("_new")) & (renamed != F.col("history_id")), "left")
    kind = F.when(section, F.when(F.col("_new").isNotNull(), "relocatedOld").otherwise("historical")).otherwise(F.col("kind"))
    more = more.select(*[kind.alias(c) if c == "kind" else F.col(c) for c in columns])
    hits = met.select(F.explode("_met.history_id").alias("history_id")).groupBy("history_id").agg(F.count("*").alias("matched"))
    report = stamps.select("history_id").distinct().join(hits, "history_id", "left").select("history_id", F.coalesce("matched", F.lit(0)).alias("matched"))
    return Applied(stamped.unionByName(more), report)
