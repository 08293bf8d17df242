"""Partitions that follow the rows, and findings that need them, on lines that are repeated or have no number."""

from waybill.operators import rounds
from waybill.plans import catalog


def test_partitions_follow_the_rows(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few, many = (rounds.dealt(spark.range(n).withColumnRenamed("id", "k"), "k", rows=100) for n in (50, 2000))
    assert few.rdd.getNumPartitions() == parts and many.rdd.getNumPartitions() == 20 and many.distinct().count() == 2000


def test_draft_issues_of_repeated_lines(spark, tmp_path):
    spark.sql("select cast(id as bigint) o_orderkey, timestamp'2000-01-10' o_orderdate from range(1, 5)").write.parquet(str(tmp_path / "orders.parquet"))
    lines = "(1, 1, timestamp'2000-02-01'), (1, 1, timestamp'2000-02-01'), (2, null, timestamp'2000-02-01'), (2, 2, timestamp'2000-01-11'), (3, 1, timestamp'2000-02-01'), (3, 2, null)"
    spark.sql(f"select cast(col1 as bigint) l_orderkey, cast(col2 as int) l_linenumber, col3 l_shipdate from values {lines}").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.o_orderkey: (r.issues, r.blocks) for r in catalog.QUERIES["q_draft_issues"](spark, str(tmp_path)).collect()}
    assert got == {1: ("repeated_call", False), 2: ("ends_before_start,repeated_call", False), 3: ("", False), 4: ("too_few_calls", True)}
