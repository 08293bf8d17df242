"""Crowded places: nearest ones and pairs against plain versions, with copies, ties and points that lie alone."""

import math
import random

from waybill.operators import greedy, shapes


def places(n, seed):
    rnd = random.Random(seed)
    out = [(rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for _ in range(n)] + [(1.0, 1.0), (1.125, 1.0), (0.875, 1.0), (3.0, 3.0)]
    return [(i, *p) for i, p in enumerate(out + out[: n // 4] + out[: n // 8])]


def test_nearest_in_a_crowd(spark):
    rows = places(300, 1)
    df = spark.createDataFrame([*rows, (9000, None, 0.0), (9001, math.nan, 0.0)], "p long, x double, y double")
    assert shapes.fine_level(df.select("x", "y").where("p < 9000"), df.select("x", "y").where("p < 9000"), 0.5, 8) > 2
    got = {r.p: (r.distance, r.other) for r in shapes.nearest(df, df, "p", "p", "x", "y", 0.5).collect()}
    for p, x, y in rows:
        best = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), q) for q, a, b in rows if q != p)
        assert (got.pop(p, None) or (None,))[-1] == (best[1] if best[0] <= 0.5 else None), p
    assert not got


def test_nearest_segment_in_a_crowd(spark):
    dots = places(200, 2)
    rnd = random.Random(3)
    lines = [(k, rnd.gauss(0, 0.01), rnd.gauss(0, 0.01), rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for k in range(120)]
    lines += [(k + 500, *ends) for k, *ends in lines[:40]] + [(700, 1.25, 0.5, 1.25, 2.0), (701, 1.25, 0.5, 1.25, 2.0), (702, 2.0, 2.0, 2.0, 2.0)]
    own = spark.createDataFrame(dots, "p int, x double, y double")
    assert shapes.fine_level(own.select("x", "y").distinct(), own.select("x", "y").distinct(), 0.3, 16) > 0
    got = {r.p: (r.s, r.distance) for r in shapes.nearest_segment(own, spark.createDataFrame(lines, "s int, ax double, ay double, bx double, by double"), "p", "s", 0.3).collect()}

    def apart(x, y, ax, ay, bx, by):
        sq = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / sq)) if sq else 0.0
        return math.sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)

    for p, x, y in dots:
        d, s = min((apart(x, y, *ends), s) for s, *ends in lines)
        if d > 0.3:
            assert p not in got
        else:
            assert got[p][0] == s and abs(got[p][1] - d) < 1e-12


def _pairs(seed):
    rnd = random.Random(seed)
    rows = [(i, i % 2, rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for i in range(160)]
    rows += [(i + 1000, i // 2 % 2, x, y) for i, _, x, y in rows[:60]] + [(2000 + i, i % 2, 1 + i / 16, 1.0) for i in range(12)]
    a, b = ([(i, x, y) for i, s, x, y in rows if s == k] for k in (0, 1))
    near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), i, j) for i, x, y in a for j, u, v in b)
    return a, b, [p for p in near if p[0] <= 0.25]


def test_one_to_one_in_a_crowd(spark):
    a, b, near = _pairs(5)
    want, used = [], (set(), set())
    for d, i, j in near:
        if i not in used[0] and j not in used[1]:
            want.append((i, j, d))
            used[0].add(i), used[1].add(j)
    left, right = (spark.createDataFrame(rows, "id int, x double, y double") for rows in (a, b))
    assert sorted(map(tuple, greedy.one_to_one_near(left, right, 0.25).collect())) == sorted(want)


def test_nearest_once_in_a_crowd(spark):
    a, b, near = _pairs(6)
    b = [*b, (0, 0.5, 0.5)]  # an id that is on both sides
    a = [*a, (5000, 0.5, 0.45)]
    near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), i, j) for i, x, y in a for j, u, v in b)
    mine, theirs = {}, {}
    for d, i, j in near:
        if d <= 0.25:
            mine.setdefault(i, (d, j))
    for i, (d, j) in mine.items():
        theirs[j] = min(theirs.get(j, (d, i)), (d, i))
    left, right = (spark.createDataFrame(rows, "id int, x double, y double") for rows in (a, b))
    assert sorted(map(tuple, greedy.nearest_once_near(left, right, 0.25).collect())) == sorted((i, j, d) for j, (d, i) in theirs.items())
