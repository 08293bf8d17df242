"""Edges of a walk: broadcast ones and shuffled ones are the same."""

from waybill.operators import chains


def test_few_and_many_edges(spark):
    points = spark.createDataFrame([(j, k, (j * k * k + k) % 7) for j in range(20) for k in range(6)], "j int, pos int, place int")
    edges = spark.createDataFrame([(a, b, b - a + 0.5, 1) for a in range(7) for b in range(a, 7) if (a * b) % 3], "a int, b int, m double, mask int")
    step = lambda x, y: float(abs(x - y))
    few, many = (sorted(map(tuple, chains.edge_walk(points, edges, "j", step, 3.0, few=n).collect())) for n in (100, 0))
    assert few == many and {r[2] for r in few} == {"edge", "gap"}
