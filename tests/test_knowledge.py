"""The classified read on tables made here."""

import datetime

from waybill.sources import knowledge


def test_known(spark, tmp_path):
    root, day = str(tmp_path), datetime.date(2026, 9, 1)
    services = spark.createDataFrame([("s1", "jp"), ("s9", "fr")], "id string, region string")
    ask = lambda country="jp", at="2026-09-01", **more: knowledge.known(spark, root, country, at, services, **more)
    rows = lambda df, c: sorted(r[c] for r in df.collect())
    got = ask()
    assert (got.availability, got.coverage, got.pattern_status, got.excerpt_status) == ("missing", None, "missing", "missing") and not got.legal_zero()
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{root}/{name}")
    save("patterns", [("p1", "s1"), ("p9", "s9"), ("p0", "s?")], knowledge.PATTERNS)
    save("excerpts", [("e1", [day]), ("e2", []), ("e3", None)], knowledge.EXCERPTS)
    save("occurrences", [("jp", "s1", day, "t1"), ("jp", "s2", day, "t2"), ("fr", "s9", day, "t9"), ("jp", "s1", datetime.date(2026, 9, 2), "t3")], knowledge.OCCURRENCES)
    save("coverage", [("jp", day, "partial"), ("jp", datetime.date(2026, 9, 5), "verified"), ("jp", datetime.date(2026, 9, 6), "verified"), ("jp", datetime.date(2026, 9, 6), "partial")], knowledge.COVERAGE)
    got = ask()
    assert (got.availability, got.coverage, got.pattern_status, got.excerpt_status) == ("ready", "partial", "loaded", "loaded")
    assert rows(got.occurrences, "trip_id") == ["t1", "t2"] and rows(got.patterns, "pattern_id") == ["p0", "p1"] and rows(got.excerpts, "trip_id") == ["e1"]
    got = ask(service="s1")
    assert rows(got.occurrences, "trip_id") == ["t1"] and rows(got.patterns, "pattern_id") == ["p1"]
    assert ask(at="2026-09-05").legal_zero() and not ask(at="2026-09-07").legal_zero()
    assert ask(at="2026-09-07").coverage == ask(at="2026-09-06").coverage == "unknown"
    got = ask(at=None)
    assert got.availability == "not requested" and got.occurrences.isEmpty() and rows(got.excerpts, "trip_id") == ["e1", "e2", "e3"]
    got = ask("fr")
    assert (got.availability, got.excerpt_status) == ("unsupported", "not applicable") and rows(got.patterns, "pattern_id") == ["p0", "p9"] and got.excerpts.isEmpty()
    (tmp_path / "broken").mkdir()
    for name in ("occurrences", "patterns"):
        for part in (tmp_path / name).glob("*"):
            part.unlink()
        for part in (tmp_path / name).glob(".*.crc"):
            part.unlink()
        (tmp_path / name / "part.parquet").write_bytes(b"no table")
    got = ask()
    assert (got.availability, got.pattern_status, got.excerpt_status) == ("damaged", "damaged", "loaded") and got.patterns.isEmpty() and got.occurrences.isEmpty()
