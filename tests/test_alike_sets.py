"""Sets that share most of their items, against all pairs."""

import random
from itertools import combinations

import pytest

from waybill.operators import relations
from waybill.plans import catalog


def test_equal_sets_are_pairs(spark, tmp_path):
    spark.createDataFrame([(k, 7) for k in (1, 2, 3)] + [(k, i) for k in (4, 5) for i in range(5 - (k == 5))], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, catalog.QUERIES["q_set_ratio"](spark, str(tmp_path)).select("a", "b", "common", "subset").collect()))
    assert got == [(1, 2, 1, True), (1, 3, 1, True), (2, 3, 1, True), (4, 5, 4, True)]


@pytest.mark.parametrize(("share", "of"), [(4, 5), (1, 2), (1, 1), (1, 3)])
def test_alike_sets(spark, share, of):
    rnd = random.Random(share * 10 + of)
    sets = {k: set(rnd.sample(range(9), rnd.randint(1, 7))) for k in range(120)}
    want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) * of >= max(len(sets[a]), len(sets[b])) * share}
    got = [tuple(r) for r in relations.alike_sets(spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k int, i int"), "k", "i", share, of).select("a", "b", "common").collect()]
    assert len(got) == len(set(got)) and set(got) == want
