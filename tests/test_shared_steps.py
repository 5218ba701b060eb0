"""How many tasks read the large tables, and what the shared steps write."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fareflow.operators import headway
from fareflow.plans import base, catalog, demand
from fareflow.sources import fixtures

PATH = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    monkeypatch.setattr(base, "_SHARED", {})
    return lambda: {key[1] for key in base._SHARED}


def _table(path, rows, group):
    pq.write_table(pa.table({"event_id": list(range(rows))}), f"{path}/events.parquet", row_group_size=group, compression="none", use_dictionary=False)


def test_one_file_of_many_row_groups_is_read_as_it_is(spark, tmp_path):
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        _table(tmp_path, 100_000, 1000)
        assert fixtures._source(spark, str(tmp_path), "events").startswith("parquet.")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_row_group_is_dealt_out_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    _table(tmp_path, 1000, 1000)
    dealt = spark.table(fixtures._source(spark, str(tmp_path), "events"))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000


def test_an_empty_table_is_read(spark, tmp_path):
    _table(tmp_path, 0, 1000)
    assert spark.sql(f"select * from {fixtures._source(spark, str(tmp_path), 'events')}").count() == 0


def test_matched_taps_are_joined_when_they_are_read(spark, written):
    plan = base.matched(spark, PATH).select("dep_s", "o_key")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "arr_s" not in plan
    assert "taps" in written() and "matched" not in written()


def test_pairs_of_the_demand_do_not_write_its_trips(spark, written):
    assert demand.od(spark, PATH).count() > 0
    assert not {"trips", "matched"} & written()


def test_quality_of_fits_does_not_write_the_rides(spark, written):
    assert catalog.queries()["speed_fit_quality"](spark, PATH).count() > 0
    assert not {"prepared", "matched"} & written()


def test_the_cache_takes_the_pairs_that_the_routes_were_made_for(spark, written, monkeypatch):
    trips, calls = demand.trips, []
    monkeypatch.setattr(demand, "trips", lambda *a: calls.append(a) or trips(*a))
    assert catalog.queries()["route_cache_merge"](spark, PATH).count() > 0
    assert len(calls) == 1


def test_taps_of_one_second_are_counted_before_they_are_put_in_order(spark):
    taps = spark.createDataFrame([("r", "s", float(t)) for t in (0, 0, 0, 60, 500, 500)], "route_name string, o_key string, dep_s double")
    found = headway.tap_clusters(taps)
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString().rpartition("Window")[2]
    assert sorted(tuple(r) for r in found.select("cluster", "center", "taps").collect()) == [(1, 0.0, 4), (2, 500.0, 2)]
