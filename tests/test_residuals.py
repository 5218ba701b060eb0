"""Residuals of trips with one transfer."""

from fareflow.operators import transfer


def test_trips_are_not_shuffled_by_period(spark):
    matched = spark.createDataFrame([("subway", False, "a", "b", 900.0, 30000.0)], "mode string, same_line boolean, o_key string, d_key string, tt_adj_s double, dep_s double")
    od = spark.createDataFrame([("a", "b", "l1", "l2", "s", 300.0)], "o_key string, d_key string, line1 string, line2 string, station string, ivt double")
    headways = spark.createDataFrame([("l1", 8, 200.0), ("l2", 8, 300.0)], "line string, hour int, headway_s double")
    per_stop = spark.createDataFrame([("all", 35.0), ("am_peak", 40.0)], "period string, c double")
    left = transfer.residuals(matched, od, 120.0, per_stop, headways)
    assert left.first()["resid"] == 900 - (120 + 80 + 300 + 100 + 150)
    joins = [line for line in left._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "period" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
