"""The next vehicle, with many requests in one hour."""

import random

from fareflow.operators import timetable


def test_next_vehicle_reads_each_hour_once(spark):
    draw = random.Random(5)
    times = [("n", "l", float(draw.randrange(0, 20_000, 50))) for _ in range(60)]
    asked = [(i, "n", "l", float(draw.randrange(0, 25_000, 25))) for i in range(400)]
    found = timetable.next_vehicle(spark.createDataFrame(asked, "id long, node string, line string, ready double"), spark.createDataFrame(times, "node string, line string, arrive double"))
    want = {i: min((a for _, _, a in times if a >= t), default=None) for i, _, _, t in asked}
    assert {r["id"]: r["vehicle"] for r in found.collect()} == want
    # Spark reads a frame that ends at the last row anew for each row
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
