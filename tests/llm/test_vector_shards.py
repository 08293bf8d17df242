"""Vectors are dealt to a bounded number of shards and shuffled once, whatever the splits; copies, full trees and united lists."""

import numpy as np
import pandas as pd
import pytest

from waybill.llm import vector_dedup


def crowd(spark, n=1500, width=8):
    x = np.random.default_rng(7).normal(size=(n, width)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + np.random.default_rng(8).normal(size=(n - n // 2, width)).astype(np.float32) * 0.05
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    return d, x.astype(float)


def test_a_class_is_in_few_shards_over_all_splits(spark):
    _, classes = vector_dedup.classes_of(crowd(spark)[0])
    rows = vector_dedup.shards_of(classes, 12, 3, 0.3).select("cid", "shard", "own").toPandas()
    by = rows.groupby("cid")
    assert len(by) == 1500 and by.size().max() == 3 and (by.own.sum() == 1).all()
    assert not rows.duplicated(["cid", "shard"]).any() and rows["shard"].nunique() > 64
    assert rows.groupby("shard").size().max() <= 24


def test_shards_grow_once_centres_are_many(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MOST_CENTRES", 8)
    _, classes = vector_dedup.classes_of(crowd(spark)[0])
    rows = vector_dedup.shards_of(classes, 12, 1).toPandas()
    assert len(rows) == 1500 and rows.own.all() and 2 <= rows["shard"].nunique() <= 16


def test_both_passes_take_vectors_from_one_shuffle(spark):
    d, x = crowd(spark)
    _, classes = vector_dedup.classes_of(d)
    links = vector_dedup._searched(classes, vector_dedup.shards_of(classes, 100, 6, 0.3), 0.98)
    found = links.groupBy().sum("pairs").collect()[0][0]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert found >= 0.95 * ((x @ x.T >= 0.98).sum() - len(x)) > 1000
    links.collect()
    assert "ReusedExchange" in links._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 100])
def test_copies_are_one_class(spark, monkeypatch, most):
    monkeypatch.setattr(vector_dedup, "MOST_COPIED", most)
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, -3.0]
    made = [(5, v, 0), (4, v, 0), (3, v, 1), (2, w, 0), (None, w, 0), (1, [1.0, 2.0, 3.001], 0), (8, [float("-inf"), 1.0, 1.0], 0), (9, [1.0, None, 2.0], 0)]
    d = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    _, classes = vector_dedup.classes_of(d)
    assert sorted((r.m, r.least) for r in classes.collect()) == [(1, 1), (1, 3), (2, 2), (2, 4)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(d).collect()}
    assert got == {5: (2, 1, False), 4: (2, 1, False), 1: (2, 1, True), 3: (0, 3, True), 2: (1, 2, True), None: (1, 2, False), 8: (0, 8, True), 9: (0, 9, True)}


def test_lists_of_other_shards_are_united():
    cids, x = np.array(["a", "b", "c", "d"], object), np.eye(4)
    digest = vector_dedup._digests(cids)
    own = np.array([1, 0, 0, 0, 1], "<u2").tobytes()  # a and b
    other = np.concatenate((digest[[1, 0]], digest[[3]], np.array([12345], np.uint64)))[[0, 3, 2, 1]]  # b and d, one that is not here and a
    lists = pd.DataFrame({"told": pd.array([int(digest.sum().astype(np.int64)), None], "Int64"), "edges": [own, other.astype("<u8").tobytes()]})
    assert [a.tolist() for a in vector_dedup._united(cids, x, lists)] == [[1], [0, 3], [], [1]]
    lists.loc[0, "told"] += 1  # built on other members
    assert all(len(a) for a in vector_dedup._united(cids, x, lists))


def test_lists_are_pruned_as_one_by_one():
    x = vector_dedup._unit(np.random.default_rng(4).normal(size=(300, 5)))
    want = [set() for _ in x]
    for i, like in enumerate(x @ x.T):
        near = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-like[j], j))[: 3 * vector_dedup.DEGREE]
        kept = []
        for j in near:
            if len(kept) < vector_dedup.DEGREE and all(vector_dedup.ALPHA * (2 - 2 * x[k] @ x[j]) > 2 - 2 * like[j] for k in kept):
                kept.append(j)
        for j in kept:
            want[i].add(j)
            want[j].add(i)
    assert [a.tolist() for a in vector_dedup.build(x)] == [sorted(a) for a in want]
    assert [a.tolist() for a in vector_dedup.build(x[:1])] == [[]]
