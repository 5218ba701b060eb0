"""Readers of several files, whose order is data, and streams over several batches."""

import datetime as dt

from pyspark.sql import functions as F

from fareflow.operators import matching, network
from fareflow.sources import tables
from fareflow.streaming import streams


def test_later_files_win_whatever_their_sizes(spark, tmp_path):
    head = "scope,key,transfer_time_s,n_obs,raw_median_s\n"
    (tmp_path / "part-0.csv").write_text(head + "station,subway:S1,100,1,1\nstation,subway:S2,1,1,1\nstation,subway:S2,2,1,1\n")
    (tmp_path / "part-1.csv").write_text(head + "".join(f"station,x{k},50,1,1\n" for k in range(500)) + "station,subway:S1,200,1,1\n")
    got = {r["key"]: r["transfer_time_s"] for r in tables.read_transfers(spark, str(tmp_path)).collect()}
    assert got["subway:S1"] == 200.0 and got["subway:S2"] == 2.0 and len(got) == 502
    # the same with the sizes the other way round
    (tmp_path / "part-0.csv").write_text(head + "".join(f"station,y{k},50,1,1\n" for k in range(3000)) + "station,subway:S1,300,1,1\n")
    assert {r["key"]: r["transfer_time_s"] for r in tables.read_transfers(spark, str(tmp_path)).collect()}["subway:S1"] == 200.0


def test_first_stop_of_a_name_wins(spark, tmp_path):
    nodes, edges = tmp_path / "nodes", tmp_path / "edges"
    nodes.mkdir()
    edges.mkdir()
    head = "node_id,node_type,station_name,x,y\n"
    (nodes / "a.csv").write_text(head + "S9,subway,Twin,116.3,39.9\n")
    (nodes / "b.csv").write_text(head + "S1,subway,Twin,116.3,39.9\nS2,subway,End,116.4,39.9\n" + "".join(f"B{k},bus,Stop {k},116.3,39.9\n" for k in range(100)))
    head = "edge_type,route_name,from_id,to_id,distance,travel_time\n"
    (edges / "a.csv").write_text(head + "subway,L,S9,S1,500,60\n")
    (edges / "b.csv").write_text(head + "subway,L,S1,S2,700,80\n")
    n, e = tables.read_network(spark, str(nodes), str(edges))
    known = network.stations(n)
    stops = network.line_stops(e, known)
    assert [r["node"] for r in stops.orderBy("pos").collect()] == ["subway:S9", "subway:S1", "subway:S2"]
    taps = spark.createDataFrame([("subway", "Twin", "End")], "mode string, o_name string, d_name string")
    assert matching.subway_pairs(taps, known, stops).first()["o_key"] == "subway:S9"
    # without seq, the least key
    assert matching.subway_pairs(taps, known.drop("seq"), stops).first()["o_key"] == "subway:S1"


def test_taps_go_by_position(spark, tmp_path):
    """A byte order mark, other names in the header, empty and unreadable fields, and a limit."""
    header = "\ufeff" + ",".join(f"列{k}" for k in range(17))
    row = "c1,地铁,地铁1号线,0,3,东门,116.3,39.9,2019-05-13 08:00:00,地铁,地铁1号线,1,9,西门,116.4,39.8,2019-05-13 08:30:00"
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text("\n".join([header, row, row.replace("c1", f"d{k}").replace(",116.3", ",").replace(",9,", ",x,"), ""]), encoding="utf-8")
    got = tables.read_taps(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == tables.RAW_TAPS.split(", ")
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows[0] == rows[1] == ("c1", "地铁", "地铁1号线", 0, 3, "东门", 116.3, 39.9, "2019-05-13 08:00:00", "地铁", "地铁1号线", 1, 9, "西门", 116.4, 39.8, "2019-05-13 08:30:00")
    assert [(r[0], r[6], r[12], r[16]) for r in rows[2:]] == [(f"d{k}", None, None, "2019-05-13 08:30:00") for k in (1, 2)]
    assert tables.read_taps(spark, str(tmp_path), limit=3).count() == 3


def _at(seconds):
    return dt.datetime(2019, 5, 13, 6, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def _run(spark, tmp_path, batches, make, schema):
    """Each batch in a run of its own, so that the query goes on from its checkpoint."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        streams.run_available(make(spark.readStream.schema(schema).parquet(folder)), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


def test_windows_over_three_batches_with_a_restart_and_late_rows(spark, tmp_path):
    first = [(_at(k * 3), "bus") for k in range(200)]
    second = [(_at(590), "bus"), *((_at(600 + k * 3), "subway") for k in range(1600))]
    late = [(_at(7), "bus"), (_at(8), "tram")]  # their window is closed: the watermark is at 1,797 seconds
    third = [*late, (_at(2000), "bus"), (_at(12_000), "bus")]
    got = _run(spark, tmp_path, [first, second, third], streams.stream_buckets, "ts timestamp, mode string")
    seen = spark.createDataFrame([r for r in [*first, *second, *third] if r not in late], "ts timestamp, mode string")
    closed = F.col("start") + F.expr("interval 10 seconds") <= F.lit(_at(12_000 - 3600))
    want = seen.groupBy(F.window("ts", "10 seconds").alias("w"), "mode").agg(F.count("*").alias("trips")).select(F.col("w.start").alias("start"), "mode", "trips").where(closed)
    rows = [sorted(map(tuple, df.collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 500 and ("tram" not in {r[1] for r in rows[0]})


def test_sessions_grow_across_batches(spark, tmp_path):
    tap = lambda s, stop="A": (_at(s), "300", stop)
    batches = [[tap(0), tap(60), tap(50, "B")], [tap(120), tap(200), tap(400), tap(3700)], [tap(3750), tap(20, "B"), tap(5, "B"), tap(20_000)]]
    got = _run(spark, tmp_path, batches, streams.stream_clusters, "ts timestamp, route_name string, o_key string")
    rows = sorted((r["o_key"], (r["first"].timestamp() - _at(0).timestamp()), (r["last"].timestamp() - _at(0).timestamp()), r["taps"]) for r in got.collect())
    # the watermark is at 100 seconds then: the tap at 20 would end a session at 110, the one at 5 at 95
    assert rows == [("A", 0.0, 200.0, 4), ("A", 400.0, 400.0, 1), ("A", 3700.0, 3750.0, 2), ("B", 20.0, 50.0, 2)]
