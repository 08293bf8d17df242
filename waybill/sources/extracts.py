"""Map extracts in XML as tables of nodes, ways and relations, cut down to what a network needs.

Elements are split by Spark's XML source, so a large uncompressed extract is read by many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators import rounds

#: Tags of tracks, of routes over them, of stop areas, and of stations.
TRACKS = ("rail", "subway", "light_rail", "tram", "monorail", "narrow_gauge", "funicular")
ROUTES = (*TRACKS, "train", "railway", "tracks")
MASTERS = (*TRACKS, "train")
AREAS = ("stop_area", "stop_area_group")
STATIONS = ("station", "halt", "stop")
PLATFORMS = ("station", "stop_position", "platform")

_TAGS = "tag array<struct<_k: string, _v: string>>"
_SCHEMAS = {
    "node": f"_id long, _version int, _lon double, _lat double, {_TAGS}",
    "way": f"_id long, _version int, nd array<struct<_ref: long>>, {_TAGS}",
    "relation": f"_id long, _version int, member array<struct<_type: string, _ref: long, _role: string>>, {_TAGS}",
}


class Extract(NamedTuple):
    """nodes (id, lon, lat, tags, version), ways (id, nodes, tags, version), relations (id, members, tags, version), and
    missing (owner, owner_id, place, type, ref): places in a kept way or relation whose element the extract lacks."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    missing: DataFrame


def elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All elements of a kind, one row an id: the highest version, of equal ones the greatest by content."""
    raw = spark.read.format("xml").option("rowTag", kind).schema(_SCHEMAS[kind]).load(path).where("_id is not null")
    own = [c for c in raw.columns if c not in ("_id", "tag")]
    tags = F.array_sort(F.coalesce(F.filter("tag", lambda t: t["_k"].isNotNull()), F.array().cast("array<struct<_k: string, _v: string>>")))
    newest = raw.groupBy(F.col("_id").alias("id")).agg(F.max(F.struct(*own, tags.alias("tag"))).alias("e")).select("id", "e.*")
    firsts = F.filter("tag", lambda t, i: (i == 0) | ~t["_k"].eqNullSafe(F.get("tag", i - 1)["_k"]))  # a key twice is one entry
    return newest.withColumn("tags", F.map_from_entries(firsts)).withColumnRenamed("_version", "version").drop("tag")


def _tagged(key: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at("tags", F.lit(key)).isin(*values), F.lit(False))


def network(spark: SparkSession, path: str, follow: bool = False, most_rounds: int = 100) -> Extract:
    """The tracks, routes, stop areas and stations of an extract, with all nodes that they name.

    Members stay in order. Without ``follow`` a relation's members that are no tracks or routes themselves stay names; with
    it they come too, relations in relations until none is new. Nodes without a valid location are as missing.
    """
    ways, relations = (elements(spark, path, k) for k in ("way", "relation"))
    ways = ways.select("id", F.coalesce("nd._ref", F.array().cast("array<bigint>")).alias("nodes"), "tags", "version")
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    no_members = F.array().cast("array<struct<type: string, ref: bigint, role: string>>")
    relations = rounds.settled(relations.select("id", F.coalesce(member, no_members).alias("members"), "tags", "version"))
    kept = rounds.settled(relations.where(_tagged("route", ROUTES) | _tagged("route_master", MASTERS) | _tagged("public_transport", AREAS)))
    by_tag = _tagged("railway", TRACKS)
    if follow:
        new = kept
        for _ in range(most_rounds):
            inner = new.select(F.explode("members").alias("m")).where("m.type = 'relation'").select(F.col("m.ref").alias("id")).distinct()
            new = rounds.settled(relations.join(inner, "id", "left_semi").join(kept.select("id"), "id", "left_anti"))
            if new.isEmpty():
                break
            kept = rounds.settled(kept.unionByName(new))
        else:
            raise RuntimeError(f"relations did not end in {most_rounds} rounds")
        named = kept.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()
        ways = ways.join(named.withColumn("_named", F.lit(True)), "id", "left").where(by_tag | F.col("_named")).drop("_named")
    else:
        ways = ways.where(by_tag)
    ways = rounds.settled(ways)
    of_ways = ways.select(F.lit("way").alias("owner"), F.col("id").alias("owner_id"), F.posexplode("nodes").alias("place", "ref")).withColumn("type", F.lit("node"))
    of_relations = kept.select(F.lit("relation").alias("owner"), F.col("id").alias("owner_id"), F.posexplode("members").alias("place", "m"))
    of_relations = of_relations.select("owner", "owner_id", "place", F.col("m.ref").alias("ref"), F.col("m.type").alias("type"))
    names = of_ways.unionByName(of_relations)
    wanted = names.where("type = 'node'").select(F.col("ref").alias("id")).distinct().withColumn("_named", F.lit(True))
    nodes = elements(spark, path, "node").select("id", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), "tags", "version")
    nodes = nodes.where("lon between -180 and 180 and lat between -90 and 90")
    station = _tagged("railway", STATIONS) | _tagged("public_transport", PLATFORMS)
    nodes = rounds.settled(nodes.join(wanted, "id", "left").where(F.col("_named") | station).drop("_named"))
    known = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref"))
    for kind, frame in (("way", ways), ("relation", kept)):
        known = known.unionByName(frame.select(F.lit(kind).alias("type"), F.col("id").alias("ref")))
    missing = names.join(known, ["type", "ref"], "left_anti")
    if not follow:  # what the filter leaves out is no fault of the extract
        missing = missing.where("type = 'node'")
    return Extract(nodes, ways, kept, missing.select("owner", "owner_id", "place", "type", "ref"))
