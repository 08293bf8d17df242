"""The joins of a match in stages send no side to the driver."""

from waybill.plans import catalog


def test_stages_broadcast_nothing(spark):
    own = catalog.QUERIES["q_three_stage_match"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in own._jdf.queryExecution().executedPlan().toString()
