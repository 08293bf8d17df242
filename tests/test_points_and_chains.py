"""Texts of points and cheapest chains: the quick ways are the plain ones, and are the ones taken."""

import contextlib
import io
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from waybill.functions import geo
from waybill.operators import chains
from waybill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_decimals_near_ties(spark):
    values = [0.00000005, 0.00000015, 0.12345675, 0.12345685, -0.12345675, 179.99999995, 199.99999999, 200.00000005, 300.1234567, 1e9 + 0.5, -0.0, 1e-9, 5.0, 2.5e-7]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", geo.decimal_text(F.col("x")).alias("t")).collect()
    for r in got:
        assert r.t == str(abs(x) if (x := float(Decimal(str(r.x)).quantize(Decimal("1e-7"), ROUND_HALF_EVEN))) == 0 else x), r
    points = spark.createDataFrame([([(1.5, 2.0), (0.25, -3.0)],)], "p array<struct<lon: double, lat: double>>")
    texts = points.select(geo.undirected_json(F.col("p")), geo.undirected_texts(F.array(*[geo.point_json(F.col("p")[k]["lon"], F.col("p")[k]["lat"]) for k in (0, 1)]))).first()
    assert texts[0] == texts[1] == "[[0.25,-3.0],[1.5,2.0]]"


def test_texts_of_points_are_not_made_in_lambdas(spark):
    own = catalog.QUERIES["q_geometry_ids"](spark, FOLDER)
    assert "bround" not in "".join(x for x in plan(own).splitlines() if "lambda" in x)


def test_chains_shuffle_once_and_join_nothing(spark):
    own = plan(catalog.QUERIES["q_cheapest_chain"](spark, FOLDER))
    assert "Join" not in own and own.count("Exchange") == 1


def test_labels_of_equal_cost(spark):
    rows = [("j", 2, 1, 5, 1, 2, 1), ("j", 2, 1, 4, 1, 2, 1), ("j", 2, 1, 3, 1, None, 0), ("j", 2, 2, 9, 2, 7, 1), ("j", 2, 2, 8, 3, 7, 0), ("k", 1, 1, 2, 1, 1, 4)]
    df = spark.createDataFrame(rows, "j string, of int, layer int, id int, a int, b int, cost int")
    assert {r.j: (r.cost, r.chain) for r in chains.cheapest_chain(df, "j").collect()} == {"j": (2, [4, 9]), "k": (4, [2])}
