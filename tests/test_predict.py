"""Predictions for rides of few modes."""

from fareflow.operators import speed


def test_rides_are_not_shuffled_by_mode(spark):
    rides = spark.createDataFrame([("bus", 2, 1.0, 1000.0, 400.0)], "mode string, n_intermediate int, is_terminal double, route_dist_m double, tt double")
    given = spark.createDataFrame([("bus", "mode", "all", 40.0, 30.0, 0.0, 0.15)], "mode string, scope string, period string, dwell_s double, fitted_hold_s double, intercept_s double, b double")
    made = speed.predict(rides, given)
    assert made.first()["pred"] == 300.0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
