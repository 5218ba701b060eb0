"""The plan of the cleaned taps."""

from fareflow.operators import clean
from fareflow.plans import base


def test_filters_do_not_go_into_the_joins_of_the_mapping(spark):
    plan = clean.clean_taps(base.mapped_taps(spark, "/root/testdata/sf0.001"), keep=base.ROW)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("concat" in line or "atleast" in line for line in joins)
