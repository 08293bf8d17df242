"""Kept sets of groups of both sorts, and journeys' sets: lines are summed up after they are dealt, and are dealt no more than needed."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import greedy
from waybill.plans import catalog, routes
from waybill.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "group int, id int, place int, items array<int>"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize(("part", "few"), [(4, 40), (5, 40), (4, 0), (5, 10_000)])
def test_groups_of_both_sorts(spark, part, few):
    r = random.Random(part + few)
    rows = [(r.choice([None, 1, 1, 1, 2, 2, 3, 4, 4, 4, 4]), i, p, r.sample(range(9), r.randrange(0, 6))) for i, p in enumerate(r.sample(range(1000), 160))]
    rows += [(5, 1000, 1, []), (5, 1001, 2, []), (5, 1002, 3, [1])]
    rows = [x for x in rows if x[0] is not None or x[1] < 40]
    got = [x.id for x in greedy.without_overlap(spark.createDataFrame(rows, SCHEMA).repartition(3, "group"), part, 5, few).where("group is not null").collect()]
    want, kept = set(), {}
    for g, i, _, items in sorted((x for x in rows if x[0] is not None), key=lambda x: x[2]):
        if not any(len(set(items) & s) * 5 >= len(items) * part for s in kept.setdefault(g, [])):
            want.add(i)
            kept[g].append(set(items))
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


def test_what_comes_by_group_is_not_dealt_again(spark, monkeypatch):
    written, settled = [], greedy.rounds.settled
    monkeypatch.setattr(greedy.rounds, "settled", lambda df: written.append(plan(df)) or settled(df))
    sets = spark.createDataFrame([(i % 5, i, i, [i % 3, 7]) for i in range(60)], SCHEMA).repartition(3, "group")
    got = greedy.without_overlap(sets)
    assert sum(p.count("Exchange") for p in [*written, plan(got)]) == 1 and got.count() == 15


def test_lines_are_summed_up_after_they_are_dealt(spark):
    sets = plan(routes.journey_sets(Tables(spark, FOLDER), 8, "id"))
    lines = sets[sets.index("HashAggregate") :]
    lines = lines[: lines.index("lineitem.parquet")]
    assert "HashAggregate" not in lines[lines.index("Exchange") :]
    assert sets.count("Exchange") == 3


def test_partitions_of_journeys_follow_the_rows(spark, monkeypatch):
    dealt = routes.rounds.dealt
    monkeypatch.setattr(routes.rounds, "dealt", lambda df, *keys, count: dealt(df, *keys, rows=100, count=count))
    own = Tables(spark, FOLDER)
    assert routes.journey_sets(own, 8, "id").rdd.getNumPartitions() == -(-max(own.orders.count(), own.lineitem.count() // 4) // 100)


@pytest.mark.parametrize("name", ["q_corridors", "q_containment"])
def test_orders_without_lines_and_repeated_ones(spark, tmp_path, name):
    spark.sql("select cast(col1 as bigint) o_orderkey, cast(col2 as bigint) o_custkey, cast(col3 as double) o_totalprice from values (1, 7, 30), (2, 7, 20), (3, 7, 10), (4, 7, 5), (5, 8, 1), (null, 8, 2)").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 1, 5.0), (1, 2, 5.0), (2, 2, 1.0), (2, 1, 1.0), (2, 1, 2.0), (3, 4, 100.0), (5, 3, 1.0), (6, 3, 1.0), (None, 3, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double").withColumn("l_linenumber", F.lit(1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {x[:2] for x in map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())}
    assert got == {(7, 2), (7, 3), (8, 5)}
