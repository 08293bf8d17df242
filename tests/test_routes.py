"""Routes, chains and greedy choices against plain sequential versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import chains, greedy, routes


def plain_paths(edges, anchors, hops, may):
    found, open_ = [], [((anchors[0],), (), 0, 0, 0)]
    while open_:
        nodes, lines, m, changes, met = open_.pop()
        for line, a, b, step in edges:
            if a != nodes[-1] or b in nodes or (lines and lines[-1] != line and not may(lines[-1], line, a)):
                continue
            now = met + (b == anchors[met + 1])
            state = (*nodes, b), (*lines, line), m + step, changes + bool(lines and lines[-1] != line), now
            if now == len(anchors) - 1:
                found.append((state[2], state[3], len(state[1]), list(state[0]), list(state[1])))
            elif b != anchors[-1] and len(state[1]) < hops:
                open_.append(state)
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_k_best(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(4), *r.sample(range(12), 2)) for _ in range(70)})
    edges = [(*e, r.randrange(1, 6)) for e in edges]
    asked = {i: r.sample(range(12), 2 + i % 2) for i in range(12)}
    may = lambda x, y, at: (x + y + at) % 3 != 0
    got = routes.k_best(
        spark.createDataFrame(edges, "line long, a long, b long, m long"), spark.createDataFrame(list(asked.items()), "request long, anchors array<long>"), 5, 3, 500, may
    ).collect()
    for i, anchors in asked.items():
        own = sorted((x for x in got if x.request == i), key=lambda x: x["rank"])
        assert [(x.m, x.transfers, x.hops, x.nodes, x.lines) for x in own] == plain_paths(edges, anchors, 5, may)[:3]
        assert not any(x.pruned for x in own)
    few = routes.k_best(
        spark.createDataFrame(edges, "line long, a long, b long, m long"), spark.createDataFrame(list(asked.items()), "request long, anchors array<long>"), 5, 3, 1, may
    ).collect()
    assert any(x.pruned for x in few)


def test_with_changes(spark):
    r = random.Random(3)
    edges = sorted({(r.randrange(5), *r.sample(range(15), 2)) for _ in range(60)})
    edges = [(*e, r.randrange(0, 4)) for e in edges]
    got = {(x.start, x.node): (x.m, x.transfers, x.stops) for x in routes.with_changes(spark.createDataFrame(edges, "line long, a long, b long, m long"), spark.createDataFrame([(0,), (1,)], "node long"), 30).collect()}
    for start in (0, 1):
        best = {}
        open_ = [((0, 0, [start]), start, line) for line in {e[0] for e in edges if e[1] == start}]
        while open_:
            label, at, line = min(open_)
            open_.remove((label, at, line))
            if best.get((at, line), (10**9,)) <= label:
                continue
            best[at, line] = label
            for other in {e[0] for e in edges if e[1] == at} - {line}:
                open_.append(((label[0], label[1] + 1, label[2]), at, other))
            open_ += [((label[0] + m, label[1], [*label[2], b]), b, line) for w, a, b, m in edges if w == line and a == at and b not in label[2]]
        for node in range(15):
            want = min((v for (at, _), v in best.items() if at == node), default=None)
            assert got.get((start, node), (None,))[:2] == (want[:2] if want else (None,)), (start, node)
            if want:
                stops = got[start, node][2]
                assert stops[0] == start and stops[-1] == node and all(any(e[1:3] == p for e in edges) for p in zip(stops, stops[1:]))


def test_cheapest_chain(spark):
    r = random.Random(4)
    of = {j: r.randrange(1, 6) for j in range(60)}
    rows = [(j, of[j], layer, k, r.randrange(3), r.randrange(3), r.randrange(5)) for j in range(60) for layer in range(1, of[j] + 1) for k in range(r.randrange(0 if j % 9 == 0 else 1, 5))]
    df = spark.createDataFrame(rows, "j int, of int, layer int, id int, a int, b int, cost int").repartition(3)
    got = {x.j: (x.cost, x.chain) for x in chains.cheapest_chain(df, "j").collect()}
    for j in range(60):
        layers = [[x for x in rows if x[0] == j and x[2] == n] for n in range(1, of[j] + 1)]
        ways = [(sum(x[6] for x in way), [x[3] for x in way]) for way in itertools.product(*layers) if all(p[5] == q[4] for p, q in zip(way, way[1:]))]
        assert got.get(j) == (min(ways) if ways else None)
    assert 10 < len(got) < 60


def test_embedded(spark):
    r = random.Random(5)
    rows = [(i, [r.choice("abc") for _ in range(r.randrange(0, 4))], [r.choice(["a", "b", "c", None]) for _ in range(r.randrange(0, 9))]) for i in range(300)]
    rows.append((300, ["a"] * 20, ["a"] * 40))
    df = spark.createDataFrame(rows, "id int, p array<string>, x array<string>")
    got = {k.id: k.e for k in df.select("id", chains.embedded(F.col("p"), F.col("x")).alias("e")).collect()}
    seen = set()
    for i, p, x in rows[:-1]:
        ways = [c for c in itertools.combinations(range(len(x)), len(p)) if all(x[k] == y for k, y in zip(c, p))]
        assert got[i].n == min(2, len(ways)) and got[i].places == (list(ways[0]) if len(ways) == 1 else None)
        seen.add(got[i].n)
    assert seen == {0, 1, 2} and got[300].n == 2


def plain_bounds(stops, sections):
    def same(c, n, d, m):
        return c == d if c and d else bool(n and m and n == m)

    if len(stops) < 2 or not sections:
        return None
    at = lambda s, side, stop: same(s[side], s[side + 1], *stop)
    if not (at(sections[0], 0, stops[0]) and at(sections[-1], 2, stops[-1])):
        return None
    if len(sections) == len(stops) - 1 and all(at(s, 0, stops[i]) and at(s, 2, stops[i + 1]) for i, s in enumerate(sections)):
        return list(range(len(stops)))
    if not all((s[0] or s[1]) and (s[2] or s[3]) for s in sections) or not all(same(p[2], p[3], q[0], q[1]) for p, q in zip(sections, sections[1:])):
        return None
    out = [0]
    for i, s in enumerate(sections[:-1]):
        if len(out) < len(stops) - 1 and at(s, 2, stops[len(out)]):
            out.append(i + 1)
    return [*out, len(sections)] if len(out) == len(stops) - 1 else None


def test_section_bounds(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        path = [r.choice("ABCD") for _ in range(r.randrange(2, 6))]
        label = lambda p: r.choice([(p, None), (p, p.lower()), (None, p.lower()), (p, p.lower())])
        sections = [(*label(a), *label(b)) for a, b in zip(path, path[1:])]
        inner = sorted(r.sample(range(1, len(path) - 1), r.randrange(0, max(1, len(path) - 1)))) if len(path) > 2 else []
        stops = [label(path[k]) for k in (0, *inner, len(path) - 1)]
        if r.random() < 0.2:
            stops[r.randrange(len(stops))] = r.choice([("Z", None), (None, None), ("", "a")])
        rows.append((i, stops, sections))
    rows += [(400, [], []), (401, [("A", None)], [("A", None, "A", None)])]
    df = spark.createDataFrame(rows, "id int, stops array<struct<code:string,name:string>>, sections array<struct<from_code:string,from_name:string,to_code:string,to_name:string>>")
    got = {x.id: x.b for x in df.select("id", chains.section_bounds(F.col("stops"), F.col("sections")).alias("b")).collect()}
    for i, stops, sections in rows:
        assert got[i] == plain_bounds(stops, sections), (stops, sections)
    assert sum(x is not None for x in got.values()) > 50


def test_edge_walk_by_hand(spark):
    points = [(1, k, p) for k, p in enumerate([0, 1, 2, 9, 4, 4, 5, 20])] + [(2, 0, 3)] + [(3, 0, 0), (3, 1, 30), (3, 2, 31)]
    edges = [(0, 1, 10.0, 1), (1, 4, 7.0, 2), (4, 5, 3.0, 4), (30, 31, 1.0, 8)]
    step = lambda a, b: float(abs(a - b))
    got = chains.edge_walk(spark.createDataFrame(points, "j int, pos int, place int"), spark.createDataFrame(edges, "a int, b int, m double, mask int"), "j", step, 25.0).orderBy("j", "seq").collect()
    assert [tuple(x)[0:1] + tuple(x)[2:] for x in got] == [
        (1, "edge", 0, 1, 10.0, 1),
        (1, "edge", 1, 4, 7.0, 2),  # 2 and 9 lie between its ends
        (1, "edge", 4, 5, 3.0, 4),
        (1, "gap", 5, 20, 15.0, 4),  # the end inherits the edge it left
        (3, "gap", 0, 30, 30.0, 0),  # too long to belong to any
        (3, "edge", 30, 31, 1.0, 8),
    ]


@pytest.mark.parametrize("part", [4, 5])
def test_without_overlap(spark, part):
    r = random.Random(part)
    rows = [(i % 7, i, p, r.sample(range(9), r.randrange(0, 6))) for i, p in enumerate(r.sample(range(1000), 160))]
    got = {x.id for x in greedy.without_overlap(spark.createDataFrame(rows, "group int, id int, place int, items array<int>").repartition(3), part, 5).collect()}
    want, kept = set(), {}
    for g, i, _, items in sorted(rows, key=lambda x: x[2]):
        if not any(len(set(items) & s) * 5 >= len(items) * part for s in kept.setdefault(g, [])):
            want.add(i)
            kept[g].append(set(items))
    assert got == want and len(want) < 160


def test_one_to_one(spark):
    r = random.Random(8)
    a, b = ([(i, r.randrange(40) / 4, r.randrange(40) / 4) for i in range(n)] for n in (150, 130))
    df = [spark.createDataFrame(x, "id int, x double, y double") for x in (a, b)]
    near = greedy.pairs_near(*df, 1.0)
    pairs = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, i, j) for i, x, y in a for j, u, v in b if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 1.0)
    assert sorted((p.distance, p.left, p.right) for p in near.collect()) == pairs
    used, want = [set(), set()], []
    for d, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j), want.append((i, j, d))
    assert sorted(map(tuple, greedy.one_to_one(near).collect())) == sorted(want)
    best = {}
    for d, i, j in pairs:
        best.setdefault(i, (d, j))
    taken = {}
    for i, (d, j) in sorted(best.items(), key=lambda x: (x[1][0], x[0])):
        taken.setdefault(j, (i, j, d))
    assert sorted(map(tuple, greedy.nearest_once(near).collect())) == sorted(taken.values())


def test_nearest_segment(spark):
    from waybill.operators import shapes

    r = random.Random(9)
    dots = [(i, r.uniform(-2, 2), r.uniform(-2, 2)) for i in range(200)]
    ends = [(i, *[r.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    ends += [(60, 0.0, 0.0, 0.0, 0.0), (61, -0.3, 0.3, 1.8, 0.3), (62, -0.3, 0.3, 1.8, 0.3), (63, 0.6, -2.0, 0.6, 2.0)]
    found = shapes.nearest_segment(spark.createDataFrame(dots, "p int, x double, y double"), spark.createDataFrame(ends, "s int, ax double, ay double, bx double, by double"), "p", "s", 0.3)
    got = {x.p: (x.s, x.distance) for x in found.collect()}
    for i, x, y in dots:
        best = None
        for k, ax, ay, bx, by in ends:
            square = (bx - ax) ** 2 + (by - ay) ** 2
            at = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0.0
            d = ((x - ax - at * (bx - ax)) ** 2 + (y - ay - at * (by - ay)) ** 2) ** 0.5
            if d <= 0.3 and (best is None or d < best[1]):
                best = (k, d)
        assert (best is None) == (i not in got)
        if best:
            assert got[i][0] == best[0] and got[i][1] == pytest.approx(best[1])
