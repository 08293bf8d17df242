"""Snapping against the plain pass."""

import math
import random

from waybill.operators import snapping


def plain(points, tolerance):
    """{order: rep} by one pass in order."""
    leaders, out = [], {}
    for at, x, y in sorted(points):
        if x is None or y is None:
            out[at] = None
            continue
        scale = math.cos(math.radians(y)) * 111_320
        hit = next((k for k, lx, ly in leaders if ((x - lx) * scale) ** 2 + ((y - ly) * 110_574) ** 2 <= tolerance**2), None)
        if hit is None:
            leaders.append((at, x, y))
        out[at] = at if hit is None else hit
    return out


def held(spark, points, tolerance):
    d = spark.createDataFrame(points, "at int, lon double, lat double")
    got = snapping.snapped(d, "lon", "lat", "at", tolerance).collect()
    assert len(got) == len(points)
    assert {r["at"]: r["rep"] for r in got} == plain(points, tolerance)


def test_random_clouds_over_cell_borders(spark):
    rnd = random.Random(7)
    for lon, lat, spread in ((139.7, 35.6, 0.003), (-0.0005, 0.0005, 0.002), (25.0, -68.9, 0.004)):
        points = [(k, lon + rnd.uniform(-spread, spread), lat + rnd.uniform(-spread, spread)) for k in range(250)]
        points += [(250 + k, *points[k * 3][1:]) for k in range(40)]  # the same places again, later
        rnd.shuffle(points)
        held(spark, points, 60.0)


def test_chain_crowd_and_missing_places(spark):
    chain = [(k, 10 + k * 0.0004, 50.0) for k in range(25)]  # 28 m apart: each waits for the one before
    crowd = [(100 + k, 11.0 + k * 1e-9, 50.0) for k in range(300)]
    held(spark, chain + crowd + [(900, None, 50.0), (901, 10.0, None)], 40.0)
    empty = spark.createDataFrame([], "at int, lon double, lat double")
    assert snapping.snapped(empty, "lon", "lat", "at", 40.0).count() == 0
    still = snapping.snapped(spark.createDataFrame(chain[:3], "at int, lon double, lat double"), "lon", "lat", "at", 0.0)
    assert all(r["at"] == r["rep"] for r in still.collect())
