"""Readers and writers on files made here; rules that SQL does not check."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from waybill.functions import text
from waybill.operators import periods, relations, search, shapes
from waybill.sources import files


def test_gtfs_table(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stops.txt", "\ufeffstop_id , stop_name,parent_station\n s1 , \"One, \nTwo\" ,\ns2\n\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("routes.txt", "route_id\nr1\n")
    got = files.gtfs_table(spark, f"{tmp_path}/*.zip", "stops", ["stop_id", "stop_name", "parent_station", "stop_lat"]).drop("feed").collect()
    assert sorted(tuple(r) for r in got) == [("s1", "One, \nTwo", None, None), ("s2", None, None, None)]
    assert files.gtfs_table(spark, f"{tmp_path}/*.zip", "shapes", ["shape_id"]).count() == 0


def test_nested_feeds_and_bad_bytes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("deep/er/stops.txt", "stop_id\nwrong\n")
        z.writestr("feed/stops.txt", b"\xef\xbb\xbfstop_id,stop_name\n1,caf\xe9\n2, ok \n")
    got = files.gtfs_table(spark, str(tmp_path / "n.zip"), "stops", ["stop_id", "stop_name"]).orderBy("stop_id").collect()
    assert [(r.stop_id, r.stop_name) for r in got] == [("1", "caf\ufffd"), ("2", "ok")]
    assert files.gtfs_table(spark, str(tmp_path / "n.zip"), "trips", ["trip_id"]).count() == 0


def test_ledger_rejects(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "name": "a"}\nnot json\n{"id": "x", "name": "b"}\n{"id": 2}\n')
    glob, schema = str(tmp_path / "*.jsonl"), "id long, name string"
    assert sorted(r.id for r in files.ledger(spark, glob, schema).collect()) == [1, 2]
    bad = files.ledger_rejects(spark, glob, schema).collect()
    assert sorted(r.line for r in bad) == sorted(["not json", '{"id": "x", "name": "b"}'])
    assert all(r.file.endswith("l.jsonl") for r in bad)


def test_changed_parts_refuse_other_faults(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "day=1").mkdir()
    (tmp_path / "t" / "other=1").mkdir()
    for d in ("day=1", "other=1"):
        spark.range(1).withColumn("v", F.lit("a")).write.mode("overwrite").parquet(str(tmp_path / "t" / d))
    new = spark.createDataFrame([(1, 1, "a")], "id long, day int, v string")
    with pytest.raises(Exception, match="(?i)partition|conflict"):
        files.write_changed_parts(new, str(tmp_path / "t"), "day", "id")


def test_geojson_and_package(spark, tmp_path):
    features = [
        {"type": "Feature", "id": "a", "properties": {"name": "x"}, "geometry": {"type": "LineString", "coordinates": [[139.5, 35], [-1e-3, 36.25]]}},
        {"type": "Feature", "id": "b", "properties": {"name": None}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6, 7.5]]]}},
        {"type": "Feature", "id": "c", "properties": {}, "geometry": None},
    ]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r.id: r for r in files.geojson_features(spark, str(tmp_path / "f.json"), "name: string").collect()}
    assert [tuple(p) for p in got["a"].points] == [(139.5, 35.0), (-0.001, 36.25)] and got["a"].properties.name == "x"
    assert [tuple(p) for p in got["b"].points] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)] and got["b"].kind == "MultiLineString"
    assert got["c"].points is None
    (tmp_path / "p.json").write_text(json.dumps({"lines": [["l1", "線", "Line", [["s", 1.5, 2], ["t", 3, None]]], ["l2"]]}))
    got = {r.id: r for r in files.package_lines(spark, str(tmp_path / "p.json")).collect()}
    assert [tuple(s) for s in got["l1"].stations] == [("s", 1.5, 2.0), ("t", 3.0, None)] and got["l2"].name is None


def test_ledger_and_canonical_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "run": 2, "more": 1}\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"run": 3}\n')
    got = files.ledger(spark, f"{tmp_path}/*.jsonl", "id string, run int")
    assert sorted((r.id or "", r.run) for r in got.collect()) == [("", 3), ("1", 2)]
    assert {r[0] for r in got.select(files.canonical_json(["run", "id"])).collect()} == {'{"id":"1","run":2}', '{"id":null,"run":3}'}
    rows = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (None, 9, "n"), (None, 1, "m")], "k int, at int, v string")
    assert sorted(r.v for r in files.keep_first(rows, ["k"], ["at"]).collect()) == ["b", "m"]


def test_changed_parts_are_written(spark, tmp_path):
    path = f"{tmp_path}/days"
    made = lambda rows: spark.createDataFrame(rows, "id int, v string, day string")
    assert files.write_changed_parts(made([(1, "a", "d1"), (2, "b", "d2"), (3, "c", "d3")]), path, "day", "id") == {"new": ["d1", "d2", "d3"]}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "days" / "day=d1").glob("*.parquet")}
    done = files.write_changed_parts(made([(1, "a", "d1"), (2, "B", "d2"), (4, "e", "d4")]), path, "day", "id")
    assert done == {"same": ["d1"], "changed": ["d2"], "vanished": ["d3"], "new": ["d4"]}
    assert sorted((r.id, r.v, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a", "d1"), (2, "B", "d2"), (4, "e", "d4")]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "days" / "day=d1").glob("*.parquet")}


def test_calendar_fixture(spark):
    """The smallest timetable: remove beats the weekday, add holds past the calendar's end, holidays of verified years are Sundays."""
    flags = "monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int"
    calendars = spark.createDataFrame(
        [("c", 1, 1, 1, 1, 1, 0, 0, "2026-09-01", "2026-09-29", ""), ("h", 1, 1, 1, 1, 1, 0, 0, "2026-09-01", "", "treat_as_sunday"), ("u", 1, 1, 1, 1, 1, 1, 1, "", "", "treat_as_sunday")],
        f"calendar_id string, {flags}, valid_from string, valid_until string, holiday_policy string",
    )
    exceptions = spark.createDataFrame([("c", "2026-09-28", "remove"), ("c", "2026-09-29", "add"), ("c", "2026-09-25", "add"), ("c", "2026-09-25", "remove")], "calendar_id string, service_date string, exception_type string")
    versions = spark.createDataFrame([("v", "2026-09-20", ""), ("old", "", "2026-09-20")], "timetable_version_id string, effective_from string, effective_until string")
    trips = spark.createDataFrame([("t", "v", "c"), ("h", "v", "h"), ("u", "v", "u"), ("o", "old", "c")], "trip_id string, timetable_version_id string, calendar_id string")
    holidays = spark.createDataFrame([(2026, "2026-09-22")], "year int, service_date string")
    got = periods.service_days(trips, calendars, exceptions, versions, "2026-09-17", "2026-10-01", holidays).collect()
    days = lambda k: sorted(r.service_date.day for r in got if r.trip_id == k)
    assert days("t") == [21, 22, 23, 24, 29] and days("o") == [17, 18]
    assert days("h") == [21, 23, 24, 25, 28, 29, 30] and len(days("u")) == 11
    late = periods.service_days(trips, calendars, exceptions, versions, "2027-01-04", "2027-01-06", holidays).collect()
    assert not late  # 2027 is no verified year


def test_roots_components_and_names(spark):
    chain = [(k, k - 1 if k else None) for k in range(200)] + [(900, 901), (901, None)]
    got = {r.id: (r.root, r.steps) for r in relations.roots(spark.createDataFrame(chain, "id int, parent int"), "id", "parent").collect()}
    assert got[199] == (0, 199) and got[900] == (901, 1) and got[0] == (0, 0)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 7), (160, 3)]
    got = {r.node: r.component for r in relations.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{k: 3 for k in [3, *range(100, 161)]}, 5: 5, 7: 5, 9: 5}
    named = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x-2"), (5, "y")], "id int, name string")
    assert [r.unique for r in relations.unique_names(named, "name", ["id"]).orderBy("id").collect()] == ["x", "x-3", "x-4", "x-2", "y"]


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, None), (2, "k")], "id long, key string")
    b = spark.createDataFrame([(7, None), (8, "l")], "id long, key string")
    got = sorted((r.old_id or 0, r.new_id or 0, r.kind) for r in relations.multiset_match(a, b, ["key"], "id").collect())
    assert got == [(0, 8, "added"), (1, 7, "matched"), (2, 0, "removed")]
    got = sorted((r.old_id or 0, r.new_id or 0, r.stage) for r in relations.cascade(a, b, "id", [("exact", ["key"])]).collect())
    assert got == [(0, 8, "added"), (1, 7, "exact"), (2, 0, "removed")]


def test_folded_names(spark):
    d = spark.createDataFrame([("ﾄｳｷｮｳ  駅",), ("霞ヶ関",), (None,), ("Él Niño-2 3",), ("ひらがな",)], "n string")
    got = [tuple(r) for r in d.select(text.station_key("n"), text.search_key("n")).collect()]
    assert got == [("トウキョウ駅", "トウキョウ駅"), ("霞ケ関", "霞ヶ関"), ("", None), ("ÉlNiño-23", "elnino2 3"), ("ひらがな", "ヒラガナ")]
    names = spark.createDataFrame([(" 東海道本線 ",), ("本線",), ("山手線",), (None,)], "n string")
    assert [r[0] for r in names.select(text.line_name(F.col("n"))).collect()] == ["東海道線", "線", "山手線", None]


def test_station_match_keys(spark):
    d = spark.createDataFrame([("大宮（埼玉県）",), ("三ヶ日駅",), ("駅",), ("ﾆﾂ井",), ("A - B・C [x]",), ("(only)",), ("鐵道 ()",), (None,), ("俱利伽羅",)], "n string")
    got = [r[0] for r in d.select(text.match_key(F.col("n"))).collect()]
    assert got == ["大宮", "三ケ日", "駅", "二ツ井", "abc", "(only)", "鉄道()", None, "倶利伽羅"]
    assert [tuple(r) for r in d.limit(1).select(*text.qualified(F.col("n"))).collect()] == [("大宮", "埼玉県")]
    assert [r[0] for r in d.where("n like '鐵%'").select(text.variant_key(F.col("n"))).collect()] == ["铁道"]
    assert text.words_by_script("JR線 新宿ㄱ駅2") == ["JR", "線", "新宿", "ᄀ", "駅", "2"]


def test_journey_search(spark):
    rows = [
        (1, "jp", ["op1"], ["快速 東京", None], "2026-01-02"), (2, "jp", ["op2"], ["JR East"], None), (3, "jp", [], ["JR East 2"], None), (4, "fr", None, ["Jr east"], None),
        (5, "jp", None, None, "2026-01-03"), (6, "jp", ["op1", "op2"], ["東京 特急"], None), (7, None, ["op1"], ["East", "JR"], None), (8, "jp", ["op2"], ["新宿 1-2"], None),
    ]
    d = spark.createDataFrame(rows, "id int, region string, operator_ids array<string>, fields array<string>, date string")
    operators = spark.createDataFrame([("jp", "op1", "JR East"), ("jp", "op1", "JR東"), ("fr", "op9", "Metro")], "region string, id string, name string")
    found = lambda q: sorted(r.id for r in search.journeys(d, q, operators, plain=["date"], synonyms=[["特急", "特快", "limited express"]]).collect())
    assert found(" jr EAST ") == [1, 4, 6]  # operators alone decide in jp; words of two fields don't add up
    assert found("东京") == [1, 6] and found("2026-01") == [1, 5] and found("") == list(range(1, 9)) and found("!?") == []
    assert found("Limited Express") == [6] and found("特急東京") == [] and found("東京 特快") == [6] and found("12") == [] and found("1/2") == [8]


def plain_dp(points, eps):
    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        k = 0 if not n else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
        return ((p[0] - a[0] - k * dx) ** 2 + (p[1] - a[1] - k * dy) ** 2) ** 0.5

    kept = {0, len(points) - 1}

    def cut(i, j):
        best = max(range(i + 1, j), key=lambda k: far(points[k], points[i], points[j]), default=None)
        if best is not None and far(points[best], points[i], points[j]) > eps:
            kept.add(best)
            cut(i, best)
            cut(best, j)

    cut(0, len(points) - 1)
    return kept


def test_polylines(spark):
    """Against the plain recursion on points in metres; the first latitude sets the scale."""
    path = [(float(k), float((k * 37) % 11) / 4) for k in range(60)]
    north = [(10 + k * 0.001, 60 + ((k * 29) % 17) * 0.0004) for k in range(80)]
    same = [(5.0, 5.0)] * 4 + [(5.0, 6.0), (5.0, 5.0)]
    d = spark.createDataFrame([(n, k, x, y) for n, p in (("p", path), ("n", north), ("s", same), ("q", [(1.0, 1.0)])) for k, (x, y) in enumerate(p)] + [("q", 1, None, 2.0)], "label string, k int, x double, y double")
    for tolerance in (200.0, 78_000.0):
        got = shapes.simplified(d, ["label"], "k", "x", "y", tolerance).collect()
        for name, points in (("p", path), ("n", north), ("s", same)):
            scale = 111_320 * math.cos(math.radians(points[0][1]))
            assert {r.k for r in got if r.label == name} == plain_dp([(x * scale, y * 111_320) for x, y in points], tolerance), (name, tolerance)
        assert [r.k for r in got if r.label == "q"] == [0]
    assert shapes.simplified(d, ["label"], "k", "x", "y", 0.0).count() == d.count() - 1
