"""Extracts and releases on files made here."""

import pytest
from pyspark.sql import functions as F

from waybill.sources import extracts, warehouse

XML = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
  <node id="1" version="2" lat="35.5" lon="139.5"/>
  <node id="1" version="1" lat="0" lon="0"/>
  <node id="2" version="1" lat="35.6" lon="139.6"><tag k="name" v="線 &amp; b"/></node>
  <node id="3" version="1" lat="95" lon="1"/>
  <node id="4" version="1" lat="1" lon="1"><tag k="railway" v="station"/></node>
  <node id="5" version="1" lat="2" lon="2"/>
  <node id="6" version="1" lat="3" lon="3"/>
  <node id="7" version="1" lat="4" lon="4"/>
  <way id="10" version="3"><nd ref="2"/><nd ref="1"/><nd ref="2"/><nd ref="99"/><tag k="railway" v="rail"/></way>
  <way id="11" version="1"><nd ref="6"/><nd ref="3"/><tag k="highway" v="path"/></way>
  <way id="12" version="1"><tag k="railway" v="tram"/></way>
  <relation id="20" version="1"><member type="relation" ref="21" role=""/><tag k="route_master" v="train"/></relation>
  <relation id="21" version="1"><member type="way" ref="11" role="forward"/><member type="node" ref="5" role="stop"/><member type="way" ref="10" role=""/><member type="relation" ref="22" role="x"/></relation>
  <relation id="22" version="1"><member type="relation" ref="21" role=""/><member type="way" ref="77" role=""/></relation>
  <relation id="23" version="1"><member type="node" ref="7" role=""/><tag k="type" v="boundary"/></relation>
</osm>
"""


def test_network(spark, tmp_path):
    (tmp_path / "x.osm").write_text(XML)
    got = extracts.network(spark, str(tmp_path / "x.osm"))
    assert {r.id: r.nodes for r in got.ways.collect()} == {10: [2, 1, 2, 99], 12: []}
    nodes = {r.id: r for r in got.nodes.collect()}
    assert set(nodes) == {1, 2, 4} and (nodes[1].lat, nodes[1].version) == (35.5, 2) and nodes[2].tags == {"name": "線 & b"}
    assert [r.id for r in got.relations.collect()] == [20]
    assert [tuple(r) for r in got.missing.collect()] == [("way", 10, 3, "node", 99)]


def test_network_follows_members(spark, tmp_path):
    (tmp_path / "x.osm").write_text(XML)
    got = extracts.network(spark, str(tmp_path / "x.osm"), follow=True)
    assert {r.id: [(m.type, m.ref, m.role) for m in r.members] for r in got.relations.collect()} == {
        20: [("relation", 21, "")],
        21: [("way", 11, "forward"), ("node", 5, "stop"), ("way", 10, ""), ("relation", 22, "x")],
        22: [("relation", 21, ""), ("way", 77, "")],
    }
    assert sorted(r.id for r in got.ways.collect()) == [10, 11, 12] and sorted(r.id for r in got.nodes.collect()) == [1, 2, 4, 5, 6]
    assert sorted(tuple(r) for r in got.missing.collect()) == [("relation", 22, 1, "way", 77), ("way", 10, 3, "node", 99), ("way", 11, 1, "node", 3)]


def test_releases(spark, tmp_path):
    root = f"{tmp_path}/db"
    lines = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    stops = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id int, line int")
    keys, refs = {"line": ["id"], "stop": ["id"]}, [("stop", "line", "line", "id")]
    first = warehouse.publish(spark, root, {"line": lines, "stop": stops}, keys, refs)
    assert {k: v["rows"] for k, v in first["tables"].items()} == {"line": 2, "stop": 3}
    with pytest.raises(warehouse.Refused, match="no key"):
        warehouse.publish(spark, root, {"line": lines.unionByName(lines)}, keys)
    with pytest.raises(warehouse.Refused, match="lacks"):
        warehouse.publish(spark, root, {"line": lines.where("id = 2")}, keys, refs)
    with pytest.raises(warehouse.Refused, match="came after"):
        warehouse.publish(spark, root, {"line": lines}, keys, seen="another")
    assert warehouse.catalog(spark, root) == first
    assert len(list((tmp_path / "db" / "releases").iterdir())) == 1  # what was refused is gone
    second = warehouse.publish(spark, root, {"line": lines.where("id = 1")}, keys, refs, seen=first["release"])
    assert second["tables"]["stop"] == first["tables"]["stop"] and warehouse.table(spark, root, "line").count() == 1


def test_sync(spark, tmp_path):
    root = f"{tmp_path}/db"
    made = lambda rows: spark.createDataFrame(rows, "country string, key string, v string")
    assert warehouse.sync(made([("JP", "a", "1"), ("JP", "b", None), ("FR", "c", "3")]), root, "name", ["country", "key"]) == {"insert": 3}
    new, jp = made([("JP", "a", "1"), ("JP", "b", "2"), ("JP", None, "4")]), F.col("country") == "JP"
    before = warehouse.catalog(spark, root)
    with pytest.raises(warehouse.Refused, match="'insert': 1, 'update': 1"):
        warehouse.sync(new, root, "name", ["country", "key"], jp, check=True)
    with pytest.raises(warehouse.Refused, match="no key"):  # a null in a key
        warehouse.sync(new, root, "name", ["country", "key"], jp)
    assert warehouse.catalog(spark, root) == before
    new = made([("JP", "b", "2"), ("JP", "d", "4")])
    assert warehouse.sync(new, root, "name", ["country", "key"], jp) == {"insert": 1, "update": 1, "delete": 1}
    assert sorted(map(tuple, warehouse.table(spark, root, "name").collect())) == [("FR", "c", "3"), ("JP", "b", "2"), ("JP", "d", "4")]
    held = warehouse.catalog(spark, root)
    assert warehouse.sync(new, root, "name", ["country", "key"], jp, check=True) == {} and warehouse.sync(new, root, "name", ["country", "key"], jp) == {}
    assert warehouse.catalog(spark, root) == held
    with pytest.raises(warehouse.Refused, match="scope"):
        warehouse.sync(made([("FR", "x", "1")]), root, "name", ["country", "key"], jp)
