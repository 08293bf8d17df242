"""The timetable importer on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from waybill.sources import timetables


def plain_seconds(value, previous):
    if value is None:
        return None
    parts = [int(p) for p in value.split(":")] + [0]
    at = parts[0] * 3600 + parts[1] * 60 + parts[2]
    at += previous // 86400 * 86400 if parts[0] < 24 and previous >= 86400 else 0
    if at < previous:
        if parts[0] >= 6 or previous % 86400 < 64800:
            return "time goes back"
        at += 86400
    return at if at < 172800 else "second midnight"


def test_seconds(spark):
    texts, before = ["0:10", "5:59", "6:00", "23:59:59", "24:10", "47:59", None], [-1, 300, 64799, 64800, 86399, 86400, 90000, 160000]
    d = spark.createDataFrame([(t, p) for t in texts for p in before], "t string, p long")
    for r in d.select("t", "p", timetables.seconds(F.col("t"), F.col("p")).alias("s")).collect():
        assert (r.s.fault if r.s.at is None else r.s.at) == plain_seconds(r.t, r.p), r
    bad = spark.createDataFrame([("48:00",), ("1:60",), ("1",), ("a:b",), ("1:2:3:4",), ("",)], "t string").select("t", timetables.seconds(F.col("t"), F.lit(-1)).alias("s"))
    got = {r.t: r.s.fault for r in bad.collect()}
    assert got["48:00"] == got["1:60"] == "time beyond the service day" and {got[k] for k in ("1", "a:b", "1:2:3:4", "")} == {"time of another form"}


@pytest.fixture(scope="module")
def mapping(spark):
    make = spark.createDataFrame
    return timetables.Mapping(
        make([("R1", "Op", ["l1", "l2"]), ("R2", "Other", ["l3"]), ("R3", "Op", ["l1", "l1"]), ("R4", "Op", ["nope"]), ("RR", "Op", ["l1"]), ("RR", "Op", ["l2"])], "id string, operator_name string, line_ids array<string>"),
        make([("O1", "Op")], "id string, operator_name string"),
        make([("T1", "Local train", "local")], "id string, display_name string, train_type string"),
        make([("C1", ["2026-09-02", "2026-09-01", "2026-09-02"]), ("C2", []), ("C3", ["2026-10-01"])], "id string, dates array<string>"),
        make([("S1", "a", "A"), ("S2", "b", "B"), ("S3", "c", "C"), ("S4", "far", "Far")], "id string, code string, name string"),
        make([("l1", "Op", ["a", "b"]), ("l2", "Op", ["c"]), ("l3", "Other", ["far"])], "id string, operator string, codes array<string>"),
    )


def row(name, calls, **other):
    made = [{k: v for k, v in zip(("odpt:arrivalStation", "odpt:arrivalTime", "odpt:departureStation", "odpt:departureTime"), c) if v is not None} for c in calls]
    base = {"@type": "odpt:TrainTimetable", "owl:sameAs": name, "odpt:railway": "R1", "odpt:operator": "O1", "odpt:trainType": "T1", "odpt:calendar": "C1", "odpt:trainTimetableObject": made}
    return base | {("owl:sameAs" if k == "name" else "@type" if k == "kind" else f"odpt:{k}"): v for k, v in other.items()}


CALLS = [(None, None, "S1", "23:50"), ("S2", "23:58", "S2", "0:01"), ("S3", "0:10", None, None)]


def test_import(spark, tmp_path, mapping):
    rows = [
        row("good", CALLS, trainNumber="7M", nextTrain=["x", "y"], previousTrain="w"),
        row("twice", CALLS), row("twice", CALLS),
        row("kind", CALLS, kind="other"), row(None, CALLS), row("unmapped", CALLS, railway="?", trainType="?", calendar="?"), row("ambiguous", CALLS, railway="RR"),
        row("operator", CALLS, railway="R2"), row("lines", CALLS, railway="R3"), row("unknown", CALLS, railway="R4"), row("empty", CALLS, calendar="C2"), row("late", CALLS, calendar="C3"),
        row("short", CALLS[:1]), row("none", []), row("back", [(None, None, "S1", "9:00"), ("S2", "8:00", None, None)]), row("untimed", [*CALLS, ("S3", None, None, None)]),
        row("disagree", [(None, None, "S1", "9:00"), ("S2", "9:10", "S3", "9:11")]), row("far", [(None, None, "S1", "9:00"), ("S4", "9:10", None, None)]), row("nowhere", [(None, None, "S1", "9:00"), ("S9", "9:10", None, None)]),
        row("neighbour", CALLS, nextTrain=["x", ""]),
    ]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    got = timetables.imported(spark, str(tmp_path / "t.json"), mapping, "2026-09-01", "2026-10-01")
    (trip,) = got.trips.collect()
    assert (trip.id, trip.train_number, trip.train_type, trip.operator_name, trip.line_ids) == ("good", "7M", "local", "Op", ["l1", "l2"])
    assert trip.service_dates == ["2026-09-01", "2026-09-02"] and trip.previous_ids == ["w"] and trip.next_ids == ["x", "y"]
    assert [tuple(s) for s in trip.stops] == [("a", "A", None, 85800), ("b", "B", 86280, 86460), ("c", "C", 87000, None)]
    assert sorted(map(tuple, got.lines.collect())) == [("l1", "Op", "local", "Local train"), ("l2", "Op", "local", "Local train")]
    bad = got.rejects.collect()
    assert len(bad) == len(rows) - 1 and sum(r.id == "twice" for r in bad) == 2
    why = {r.id: r.reasons for r in bad}
    assert why["twice"] == why[None] == ["identity missing or repeated"] and why["kind"] == ["not a train timetable"]
    assert why["unmapped"] == ["calendar unmapped", "railway unmapped", "station beyond the lines", "train type unmapped"]
    assert why["ambiguous"] == ["railway unmapped", "station beyond the lines"]
    assert why["operator"] == ["line unknown or of another operator", "operator is not the railway's", "station beyond the lines"]
    assert "lines of the railway unclear" in why["lines"] and "line unknown or of another operator" in why["unknown"]
    assert why["empty"] == ["calendar without dates"] and why["late"] == ["date beyond the validity"]
    assert why["short"] == why["none"] == ["fewer than two calls"] and why["back"] == ["time goes back"] and why["untimed"] == ["call without a time"]
    assert why["disagree"] == ["stations of a call disagree"] and why["far"] == ["station beyond the lines"] and why["nowhere"] == ["station unmapped"]
    assert why["neighbour"] == ["neighbour trains of another form"]
    with pytest.raises(ValueError):
        timetables.imported(spark, str(tmp_path / "t.json"), mapping, "2026-10-01", "2026-10-01")
