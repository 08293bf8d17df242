"""Shapefiles and GeoJSON snapshots made here, against plain versions."""

import hashlib
import io
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from waybill.functions import geo
from waybill.sources import shapefiles, snapshots


def shp(shapes):
    out = io.BytesIO()
    out.write(struct.pack(">i", 9994) + bytes(96))
    for k, (kind, parts) in enumerate(shapes):
        points = [p for part in parts for p in part]
        body = struct.pack("<i", kind)
        if kind == 1:
            body += struct.pack("<dd", *points[0])
        elif kind == 8:
            body += bytes(32) + struct.pack("<i", len(points))
        elif kind in (3, 13):
            starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
            body += bytes(32) + struct.pack(f"<ii{len(parts)}i", len(parts), len(points), *starts)
        if kind not in (0, 1):
            body += b"".join(struct.pack("<dd", *p) for p in points)
        if kind == 13:
            body += bytes(16 + 8 * len(points))
        out.write(struct.pack(">ii", k + 1, len(body) // 2) + body)
    return out.getvalue()


def dbf(fields, records, encoding, deleted=()):
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<B3xIHH20x", 3, len(records), 32 + 32 * len(fields) + 1, size)
    head += b"".join(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for name, w in fields) + b"\r"
    return head + b"".join((b"*" if k in deleted else b" ") + b"".join(v.encode(encoding).ljust(w) for v, (_, w) in zip(r, fields)) for k, r in enumerate(records))


FIELDS = [("N02_003", 20), ("N02_004", 20)]
SHAPES = [
    (3, [[(139.5, 35.25), (140.0, 36.0), (141.0, 36.5)], [(1.0, 2.0), (3.0, 4.0)]]),
    (13, [[(141.0, 36.5), (140.0, 36.0), (139.5, 35.25)], [(9.0, 9.0)]]),
    (0, []),
    (1, [[(5.0, 6.0)]]),
    (3, [[(7.0, 7.0), (8.0, 8.0)]]),
    (8, [[(1.5, 1.5), (2.5, 2.5)]]),
]
RECORDS = [("山手線", "東\0日本"), ("山手線", ""), ("x", "y"), ("p", "q"), ("gone", "z"), ("m", "n")]


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shapes")

    def archive(name, members):
        with zipfile.ZipFile(folder / name, "w") as z:
            for member, content in members.items():
                z.writestr(member, content)

    good = {"N02/Section.shp": shp(SHAPES), "N02/Section.dbf": dbf(FIELDS, RECORDS, "cp932", deleted=[4])}
    old = {"v1.0/Section.shp": shp(SHAPES[:1]), "v1.0/Section.dbf": dbf(FIELDS, RECORDS[:1], "cp932")}
    utf = {"N02-utf8/Section.shp": shp(SHAPES[:1]), "N02-utf8/Section.dbf": dbf(FIELDS, [("é", "ü")], "utf-8")}
    archive("good.zip", old | utf | good)
    archive("utf.zip", old | utf)
    archive("cut.zip", {"Section.shp": shp(SHAPES)[:-9], "Section.dbf": dbf(FIELDS, RECORDS, "cp932")})
    archive("layerless.zip", {"Other.shp": shp(SHAPES)})
    archive("bare.zip", {"Section.shp": shp(SHAPES)})
    lying = bytearray(shp(SHAPES[:1]))
    struct.pack_into("<i", lying, 100 + 8 + 4 + 32 + 4, 10_000)
    archive("lying.zip", {"Section.shp": bytes(lying), "Section.dbf": dbf(FIELDS, RECORDS, "cp932")})
    (folder / "none.zip").write_bytes(b"no archive")
    return folder


def test_shapefile_rows(spark, archives):
    got = shapefiles.rows(spark, str(archives / "good.zip"), "Section").orderBy("feature", "part").collect()
    assert [(r.feature, r.part, [tuple(p) for p in r.points]) for r in got] == [
        (0, 0, SHAPES[0][1][0]), (0, 1, SHAPES[0][1][1]), (1, 0, SHAPES[1][1][0]), (5, 0, SHAPES[5][1][0]),
    ]
    assert got[0].properties == {"N02_003": "山手線", "N02_004": "東日本"} and got[2].properties == {"N02_003": "山手線", "N02_004": None}
    assert {r.member for r in got} == {"N02/Section"}
    assert [(r.feature, r.part) for r in shapefiles.rows(spark, str(archives / "good.zip"), "Section", 1).orderBy("feature", "part").collect()] == [
        (0, 0), (0, 1), (1, 0), (1, 1), (3, 0), (5, 0),
    ]
    assert [r.properties for r in shapefiles.rows(spark, str(archives / "utf.zip"), "Section").where("part = 0").collect()] == [{"N02_003": "é", "N02_004": "ü"}]


def test_shapefile_rejects(spark, archives):
    got = {r.file.rpartition("/")[2]: r.error for r in shapefiles.rejects(spark, f"{archives}/*.zip", "Section").collect()}
    assert set(got) == {"cut.zip", "layerless.zip", "bare.zip", "lying.zip", "none.zip"}
    assert got["layerless.zip"] == "no Section.shp" and got["bare.zip"] == "no Section.dbf" and got["cut.zip"] == "shapes cut"
    # what lies before the damage is there
    assert shapefiles.rows(spark, str(archives / "cut.zip"), "Section").count() == 4


def plain_number(x):
    return json.dumps(round(x, 7) or 0.0)


def test_decimal_text(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1e-7, 1.2e-5, 9.99e-5, 1e-4, -3e-6, 5.0, 139.7671248, -179.9999999, 0.1, 1e-9, -1e-9]
    values += [rng.randint(-10**d, 10**d) / 1e7 for d in range(1, 11) for _ in range(50)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", geo.decimal_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [plain_number(r.x) for r in got]
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(geo.decimal_text(F.col("x"))).collect() == [(None,), (None,)]


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def plain_record(kind, properties, points):
    first = lambda names: next((properties[n].strip() for n in names if properties.get(n)), None)
    attributes = {k: first(n) for k, n in snapshots.NAMES.items()}
    if kind == "station":
        attributes |= {k: first(n) for k, n in snapshots.STATION_NAMES.items()}
    line = [[round(x, 7) or 0.0, round(y, 7) or 0.0] for x, y in points]
    geometry = min(canonical(line), canonical(line[::-1]))
    gid = "geom-" + hashlib.sha256(geometry.encode()).hexdigest()[:32]
    told = canonical({"kind": kind, "attributes": attributes, "geometry_id": gid})
    return gid, f"{kind}-" + hashlib.sha256(told.encode()).hexdigest()[:24]


def test_geojson_inventory(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[139.5, 35], [-0.00001, 36.25]]}
    back = {"type": "LineString", "coordinates": line["coordinates"][::-1]}
    many = {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6, 7.5], [8, 9]]]}
    name = {"line_name": "線", "operator": "社"}
    documents = {
        "two.json": {"sections": {"type": "FeatureCollection", "features": [{"id": "a", "properties": name, "geometry": line}, {"id": "b", "properties": name, "geometry": back}]},
                     "stations": [{"properties": {"station_name": " 駅 ", "N02_005c": "007"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}]},
        "flat.json": {"type": "FeatureCollection", "features": [
            {"properties": {"type": "Station", "name": "x", "N02_001": 11}, "geometry": line},
            {"properties": {"kind": "other", "N02_005": "y"}, "geometry": many},
            {"properties": None, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}},
            {"properties": {}, "geometry": None},
            {"properties": {"kind": "railroadsection", "station_name": "z"}, "geometry": {"type": "LineString", "coordinates": []}},
        ]},
        "list.json": [{"id": 5, "properties": {"railway": "r"}, "geometry": line}],
        "none.json": {"type": "other"},
    }
    for n, d in documents.items():
        (tmp_path / n).write_text(json.dumps(d, ensure_ascii=False))
    rows = snapshots.geojson_rows(spark, f"{tmp_path}/*.json")
    got = sorted((r.file.rpartition("/")[2], r.kind, r.feature, r.part) for r in rows.collect())
    assert got == [
        ("flat.json", "station", "0", 0), ("flat.json", "station", "1", 0), ("flat.json", "station", "1", 1),
        ("list.json", "section", "5", 0), ("two.json", "section", "a", 0), ("two.json", "section", "b", 0), ("two.json", "station", "0", 0),
    ]
    bad = sorted((r.file.rpartition("/")[2], r.feature, r.error) for r in snapshots.geojson_rejects(spark, f"{tmp_path}/*.json").collect())
    assert bad == [("flat.json", "2", "geometry of type Polygon"), ("flat.json", "3", "no geometry"), ("flat.json", "4", "no points"), ("none.json", None, "no features")]

    records = {(r.file.rpartition("/")[2], r.feature, r.kind, r.part): r for r in snapshots.inventory(rows).collect()}
    for r in rows.collect():
        own = records[r.file.rpartition("/")[2], r.feature, r.kind, r.part]
        gid, rid = plain_record(r.kind, r.properties, [tuple(p) for p in r.points])
        assert own.geometry_id == gid and own.record_id.startswith(rid)
    ids = [records["two.json", f, "section", 0].record_id for f in "ab"]
    assert ids[0][:-4] == ids[1][:-4] and [i[-4:] for i in ids] == ["-001", "-002"]
    assert records["two.json", "a", "section", 0].bbox == [-0.00001, 35.0, 139.5, 36.25]
    station = records["two.json", "0", "station", 0]
    assert (station.station_name, station.station_code, station.vertex_count) == ("駅", "007", 1)
    lines = {(r.file.rpartition("/")[2], r.kind): r for r in snapshots.identities(snapshots.inventory(rows)).where("operator = '社'").collect()}
    assert len(lines["two.json", "section"].geometry_ids) == 1 and lines["two.json", "section"].station_names == []


def test_shapefile_inventory(spark, archives):
    rows = shapefiles.rows(spark, str(archives / "good.zip"), "Section").withColumn("kind", F.lit("section"))
    got = {(r.feature, r.part): r for r in snapshots.inventory(rows).collect()}
    assert got[0, 0].geometry_id == got[1, 0].geometry_id and got[0, 0].record_id != got[1, 0].record_id
    assert got[0, 0].operator == "東日本" and got[1, 0].operator is None and got[0, 0].station_name is None
    assert snapshots.inventory(rows.where("false")).count() == 0
