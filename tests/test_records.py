"""Recorded sections against a plain version."""

import random

from pyspark.sql import functions as F

from waybill.functions import text
from waybill.operators import chains


def same(a, b):
    return a[0] == b[0] if a[0] and b[0] else bool(a[1]) and a[1] == b[1]


def one_chain(sections, stops):
    if not sections or len(stops) < 2:
        return False
    start, end = [s[:2] for s in sections], [s[2:] for s in sections]
    if not same(start[0], stops[0]) or not same(end[-1], stops[-1]):
        return False
    if any(not any(e) for e in start + end) or any(not same(e, s) for e, s in zip(end, start[1:])):
        return False
    at = 1
    for e in end[:-1]:
        at += at < len(stops) - 1 and same(e, stops[at])
    return at == len(stops) - 1


def plain(sections, stops):
    if one_chain(sections, stops):
        return [(*s, i) for i, s in enumerate(sections)]
    out = []
    for i, (a, b) in enumerate(zip(stops, stops[1:])):
        fit = [k for k, s in enumerate(sections) if same(s[:2], a) and same(s[2:], b)]
        k = i if i in fit else fit[0] if fit else None
        out.append((*(sections[k] if k is not None else (*a, *b)), k))
    return out


def test_ride_sections(spark):
    rnd = random.Random(3)
    call = lambda: (rnd.choice([None, "", "1", "2", "3"]), rnd.choice([None, "", "A", "B", "C"]))
    cases = []
    for k in range(400):
        stops = [call() for _ in range(rnd.randrange(5))]
        path = [p for s in stops for p in ([s, call()] if rnd.random() < 0.3 else [s])]
        if stops:
            path = path[: 1 + max(i for i, p in enumerate(path) if p == stops[-1])]
        sections = [(*a, *b) for a, b in zip(path, path[1:])]
        if k % 3 == 1:
            rnd.shuffle(sections)
        if k % 3 == 2:
            sections = [(*call(), *call()) for _ in range(rnd.randrange(4))] + sections[:2]
        cases.append((k, stops, sections))
    d = spark.createDataFrame(cases, "k int, stops array<struct<code: string, name: string>>, sections array<struct<from_code: string, from_name: string, to_code: string, to_name: string>>")
    got = {r.k: [tuple(s) for s in r.s] for r in d.select("k", chains.ride_sections(F.col("stops"), F.col("sections")).alias("s")).collect()}
    chained = 0
    for k, stops, sections in cases:
        chained += one_chain(sections, stops)
        assert got[k] == plain(sections, stops), (stops, sections)
    assert 20 < chained < 380


def test_station_codes(spark):
    codes = {"X-MTR-12": "MTR-12", "a-b-LR-1": "LR-1", "TRAM-x-7": "TRAM-7", "tw-NETWORK-a-b": "tw-a-b", "a-b": "a-b", "a-b-c": "a-b-c", "": "", None: None, "NETWORK-a-b": "NETWORK-a-b"}
    d = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.v for r in d.select("c", text.station_code(F.col("c")).alias("v")).collect()} == codes
