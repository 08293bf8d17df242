"""Findings about orders and lines that are repeated or have no key, against the SQL."""

import duckdb
import pytest

from waybill.plans import catalog

LATE, EARLY = "timestamp'2000-01-10'", "timestamp'1990-01-10'"
CASES = {
    "repeated orders": (f"(1, {LATE}), (1, {LATE}), (2, {LATE}), (2, {LATE}), (3, null)", f"(1, 1, {EARLY}), (1, 1, {EARLY}), (3, 1, {EARLY})"),
    "a line without a key": (f"(1, {LATE}), (2, {LATE}), (null, {LATE})", f"(1, 1, {EARLY}), (null, 1, {EARLY}), (null, 1, {EARLY}), (1, null, {EARLY}), (1, null, {LATE}), (null, null, {LATE}), (null, null, {LATE})"),
    "an order without a key": (f"(1, {LATE}), (null, {LATE}), (4, {LATE})", f"(1, 1, {EARLY})"),
    "no lines": (f"(1, {LATE}), (null, {LATE}), (1, {LATE})", ""),
}


def compared(spark, folder, name, tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, (columns, rows) in tables.items():
        df = spark.sql(f"select {columns} from values {rows}") if rows else spark.sql(f"select {columns} from values (null, null, null) where false")
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    order = lambda r: [(x is None, x or "") for x in r]
    ours = catalog.QUERIES[name](spark, folder).select("rule", "severity", "key").collect()
    return sorted(map(tuple, ours), key=order), sorted(con.execute(catalog.SQL[name]).fetchall(), key=order)


@pytest.mark.parametrize("case", CASES)
def test_findings_of_repeated_and_null_keys(spark, tmp_path, case):
    orders, lines = CASES[case]
    own = {
        "orders": ("cast(col1 as bigint) o_orderkey, cast(col2 as timestamp) o_orderdate", orders),
        "lineitem": ("cast(col1 as bigint) l_orderkey, cast(col2 as int) l_linenumber, cast(col3 as timestamp) l_shipdate", lines),
    }
    ours, theirs = compared(spark, str(tmp_path), "q_dq_findings", own)
    assert ours == theirs


@pytest.mark.parametrize("nobody", ["", f", (null, 'signup', {EARLY})"])
def test_ledger_of_null_users(spark, tmp_path, nobody):
    rows = f"(1, 'purchase', {LATE}), (1, 'view', {LATE}), (2, 'purchase', {LATE}), (2, 'signup', {EARLY}), (null, 'purchase', {LATE}), (null, 'view', {LATE}), (3, 'view', null), (3, 'view', null)"
    own = {"events": ("cast(col1 as bigint) user_id, col2 event_type, cast(col3 as timestamp) ts", rows + nobody)}
    ours, theirs = compared(spark, str(tmp_path), "q_ledger_integrity", own)
    assert ours == theirs
