"""Every query with SQL gives the rows that DuckDB gives; the others run and have a stable schema."""

import datetime
import decimal
import math
import pathlib
import re

import duckdb
import pytest

from waybill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Values of both engines in one form."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, decimal.Decimal)) and v == int(v):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}" if v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    ours = table_of(df.columns, df.collect())
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [c[0] for c in found.description]
        theirs = table_of(names, found.fetchall())
        assert ours[0] == theirs[0]
        assert len(ours[1]) == len(theirs[1])
        assert ours[1] == theirs[1]
    assert len(set(df.columns)) == len(df.columns)


#: Queries whose filter by key is what they are about.
BY_KEY = {
    "q_guarded_patch": "patches touch some parts, all parts come out",
    **dict.fromkeys(("q_overlay_apply", "q_two_stage_match", "q_snapshot_diff", "q_export_guard", "q_import_preflight", "q_moved_renamed"), "an earlier and a later state of one table, each without some rows"),
}


def test_whole_tables():
    """No query takes a part of a table's keys, but those whose subject that is, and none takes the first rows or a sample."""
    cut = re.compile(r"FROM (?:lineitem|orders|customer|part|supplier|events|documents|embeddings)\b[^()]*\bWHERE\b[^()]*(?:key|id) *(?:% *\d+|<=? *\d+|\bIN *\()")
    found = {name for name, sql in catalog.SQL.items() if cut.search(sql)}
    assert found <= set(BY_KEY), found - set(BY_KEY)
    code = re.compile(r"t\.(?:lineitem|orders|customer|part|supplier|events|documents|embeddings)\.(?:limit|sample)\(")
    for path in sorted((pathlib.Path(__file__).parent.parent / "waybill" / "plans").glob("*.py")):
        for line in path.read_text().splitlines():
            assert not code.search(line), (path.name, line.strip())
