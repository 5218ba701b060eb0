"""Golden and hand-made cases, and helpers against plain computations."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from fareflow.functions import columns as C
from fareflow.operators import choice, clean, demand, headway, metrics, network, prune, speed, timetable, validate
from fareflow.operators.quantiles import quantile_columns, quantiles


def value(spark, column, **inputs):
    names = list(inputs)
    return spark.createDataFrame([tuple(inputs.values())], names).select(column.alias("x")).first()["x"]


def written(folder):
    def cut(df):
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return cut


def test_names(spark):
    cases = [("300路外环", "300外", "300"), ("345路快车", "345快", "345"), ("夜11路", "夜11", "夜11"), ("300快外", "300快外", "300"), (" nan ", None, None), ("", None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "n string")
    got = df.select("n", C.line_variant_key(F.col("n")).alias("v"), C.line_core_key(F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in got] == cases
    stations = {"北京站": "北京", "站": "站", "东站": "东站", "站东站": "东", "T2航站楼": "2号航站楼", " 灵镜胡同 ": "灵境胡同", "nan": None}
    df = spark.createDataFrame([(s,) for s in stations], "n string")
    assert {r["n"]: r["x"] for r in df.select("n", C.station_name(F.col("n")).alias("x")).collect()} == stations


def test_periods_and_hours(spark):
    df = spark.createDataFrame([(h * 3600.0,) for h in (5, 7, 9, 17, 19, 22, 24, 31)], "s double")
    assert [r[0] for r in df.select(C.period(F.col("s"))).collect()] == ["off_peak", "am_peak", "off_peak", "pm_peak", "off_peak", "night", "night", "am_peak"]
    profile = demand.hourly_profile(spark.createDataFrame([(90_000, "bus")], "time int, origin_type string")).collect()
    assert len(profile) == 24 and sum(r["trips"] for r in profile) == 1 and max(profile, key=lambda r: r["trips"])["hour"] == 23


def test_gaps_of_ninety_seconds(spark):
    taps = spark.createDataFrame([("r", "s", t) for t in (0.0, 90.0, 181.0, 200.0)], "route_name string, o_key string, dep_s double")
    assert sorted((r["center"], r["taps"]) for r in headway.tap_clusters(taps).collect()) == [(45.0, 2), (190.5, 2)]


def test_weighted_median_is_the_lower(spark):
    df = spark.createDataFrame([("a", 10.0, 1), ("a", 20.0, 1)], "k string, v double, w int")
    assert headway.weighted_median(df, ["k"], "v", "w").first()["v"] == 10.0


def test_prior_headways(spark):
    fits = spark.createDataFrame([("mode", "subway", "all", 327.3196, 35.0, 10), ("mode", "subway", "am_peak", 292.3782, 35.0, 10)], "scope string, key string, period string, intercept_s double, dwell_s double, n_obs int")
    rows = {r["hour"]: r for r in headway.subway(fits, 113.4709).collect()}
    assert abs(rows["all"]["access_egress_s"] - 142.3196) < 1e-9 and abs(rows["7"]["access_egress_s"] - 167.3782) < 1e-9
    implied = {r["hour"]: r["headway_s"] for r in headway.subway(fits, 113.4709, mode="implied").collect()}
    assert abs(implied["all"] - 357.6974) < 1e-3


def test_broken_chains_and_loops(spark):
    edges = spark.createDataFrame([(1, "bus", "L", "a", "b", 5.0), (2, "bus", "L", "c", "d", 7.0), (3, "bus", "O", "a", "b", 1.0), (4, "bus", "O", "b", "c", 1.0), (5, "bus", "O", "c", "d", 1.0), (6, "bus", "O", "d", "a", 1.0)], "seq long, edge_type string, route_name string, from_id string, to_id string, distance double")
    known = spark.createDataFrame([(f"bus:{x}",) for x in "abcd"], "key string")
    stops = network.line_stops(edges, known)
    broken = [(r["node"], r["seg"], r["cum"]) for r in stops.where("line = 'L'").orderBy("pos").collect()]
    assert broken == [("bus:a", 0.0, 0.0), ("bus:b", 5.0, 5.0), ("bus:c", 0.0, 5.0), ("bus:d", 7.0, 12.0)]
    wrap = network.legs(stops).where("line = 'O' and o = 'bus:c' and d = 'bus:b'").first()
    assert (wrap["hops"], wrap["n_int"], wrap["dist"]) == (3, 2, 3.0)


def test_runs_are_bridged_and_split(spark):
    edges = spark.createDataFrame([(i, "subway", "L", a, b, 1.0, 2.0) for i, (a, b) in enumerate(zip("abcdefg", "bcdefgh"))], "seq long, edge_type string, route_name string, from_id string, to_id string, distance double, travel_time double")
    status = spark.createDataFrame([("L", f"subway:{x}", "pass" if x in "bc" else "keep") for x in "abcdgh"], "route_name string, key string, status string")
    got = [(r["route_name"], r["from_key"][-1] + r["to_key"][-1], r["distance"], r["travel_time"]) for r in prune.line_runs(edges, status).orderBy("seq").collect()]
    assert got == [("L_seg1", "ad", 3.0, 6.0), ("L_seg2", "gh", 1.0, 2.0)]


def test_ids_and_samples_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 37).alias("time"), F.col("id").alias("k"))
    days = df.withColumn("date", F.when(F.col("k") % 2 == 0, "2019-05-13").otherwise("2019-05-14"))
    order = ("date", "time", "k")
    numbered = [{(r["k"], r["sid"]) for r in demand.with_sid(days.repartition(n), order, written(tmp_path)).collect()} for n in (1, 8)]
    want = {(r["k"], i) for i, r in enumerate(sorted(days.collect(), key=lambda r: (r["date"], r["time"], r["k"])))}
    assert numbered[0] == numbered[1] == want
    # one second of one day is dealt to several ranges
    busy = demand.with_sid(days.withColumns({"date": F.lit("d"), "time": F.lit(5)}), order, written(tmp_path))
    assert sorted((r["k"], r["sid"]) for r in busy.collect()) == [(k, k) for k in range(1000)]
    assert demand.with_sid(days.limit(0), order, written(tmp_path)).count() == 0
    drawn = [{r["k"] for r in demand.sample(df.repartition(n), 0.123, ("k",)).collect()} for n in (1, 8)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 123


def test_robust_fit_finds_the_parameters(spark, tmp_path):
    rng = np.random.default_rng(0)
    n, d, h = rng.integers(0, 12, 3000), rng.uniform(400, 9000, 3000), rng.integers(0, 2, 3000)
    tt = 60.0 * (n + 1) + 90.0 * h + 0.16 * d + rng.standard_t(2, 3000) * 10
    rows = [("bus", "r1" if i % 2 else "r2", "off_peak", float(d[i]), int(n[i]), float(h[i]), float(tt[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "mode string, route_name string, period string, route_dist_m double, n_intermediate int, is_terminal double, tt double")
    fits = {(r["scope"], r["key"], r["period"]): r for r in speed.fit(df, written(tmp_path)).collect()}
    f = fits["mode", "bus", "all"]
    assert abs(f["dwell_s"] - 60) < 2 and abs(f["fitted_hold_s"] - 90) < 3 and abs(f["b"] - 0.16) < 0.002
    assert abs(fits["line", "r1", "all"]["b"] - 0.16) < 0.003


def test_quantiles_are_percentiles(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 7 == 0 else f"g{k % 3}", float(rng.normal(0, 30)) if k % 2 else float(rng.integers(-5, 5))) for k in range(4000)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for keys in (["k"], []):
        got = {(r["k"] if keys else "", r["share"]): r["v"] for r in quantiles(frame, keys, "v", shares).collect()}
        want = frame.where("v is not null").groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()
        assert len(got) == len(want) * len(shares)
        for r in want:
            assert np.allclose([got[r["k"] if keys else "", q] for q in shares], r["p"])
    assert quantiles(frame.limit(0), [], "v", shares).count() == 0


def test_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(8)
    rows = [("a" if k % 3 else None, float(rng.normal(0, 9)), None if k % 5 == 0 else float(rng.integers(0, 4)), None if k % 3 else 1.0) for k in range(700)]
    frame = spark.createDataFrame(rows, "k string, x double, y double, z double")
    wanted = {"x": {0.5: "mid", 0.9: "high"}, "y": {0.5: "y"}, "z": {0.1: "low"}}
    for keys in (["k"], []):
        got = {r["k"] if keys else "": r for r in quantile_columns(frame, keys, wanted, width=0.3).collect()}
        for r in frame.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.9))).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"), F.percentile("z", F.lit(0.1)).alias("z")).collect():
            own = got[r["k"] if keys else ""]
            assert np.allclose([own["mid"], own["high"], own["y"]], [*r["x"], r["y"]]) and own["low"] == r["z"]
    assert quantile_columns(frame.limit(0), ["k"], wanted).count() == 0
    counted = frame.groupBy("k", "x", "y", "z").agg(F.count("*").alias("n"))
    plain, weighted = ({r["k"]: [r["mid"], r["high"], r["y"]] for r in quantile_columns(f, ["k"], wanted, 0.3, w).collect()} for f, w in ((frame, None), (counted, "n")))
    assert plain.keys() == weighted.keys() and all(np.allclose(plain[k], weighted[k]) for k in plain)


def test_standard_errors(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows, given = [], {"bus": (40.0, 30.0, 0.0, 0.15), "subway": (35.0, 0.0, 250.0, 0.09)}
    for mode, (c, hold, a, b) in given.items():
        for _ in range(400):
            d, n, h = float(rng.integers(400, 9000)), int(rng.integers(0, 9)), float(rng.integers(0, 2))
            rows.append((mode, "r", "am_peak", d, n, h, a + c * (n + (mode == "bus")) + hold * h + b * d + float(rng.normal(0, 40))))
    prepared = spark.createDataFrame(rows, "mode string, route_name string, period string, route_dist_m double, n_intermediate int, is_terminal double, tt double")
    fits = spark.createDataFrame([("mode", m, m, "all", c, hold, a, b, 400) for m, (c, hold, a, b) in given.items()], "scope string, key string, mode string, period string, dwell_s double, fitted_hold_s double, intercept_s double, b double, n_obs long")
    for r in speed.fit_quality(prepared, fits, written(tmp_path)).collect():
        c, hold, a, b = given[r["mode"]]
        own = np.array([x[3:] for x in rows if x[0] == r["mode"]])
        d, n, h, tt = own.T
        bus = r["mode"] == "bus"
        resid = tt - a - c * (n + bus) - hold * h - b * d
        weight = (1 + (resid / speed.SCALE_S[r["mode"]]) ** 2) ** -0.75
        j = np.stack([n + 1, h, d] if bus else [np.ones(len(d)), d], axis=1) * weight[:, None]
        scale = 1.4826 * np.median(np.abs(resid - np.median(resid)))
        se = np.sqrt(np.diag(np.linalg.inv(j.T @ j))) * scale
        want = [se[0] if bus else None, se[1] if bus else None, None if bus else se[0], 3.6 / b**2 * se[-1]]
        got = [r["se_dwell_s"], r["se_hold_s"], r["se_intercept_s"], r["se_speed_kmh"]]
        assert [x is None for x in got] == [x is None for x in want]
        assert np.allclose([x for x in got if x is not None], [x for x in want if x is not None], rtol=1e-6)


def test_robust_fit_is_the_minimum(spark):
    """Against a pattern search of the loss itself, from another start; heavy tails, and bounds that hold."""
    rng = np.random.default_rng(6)
    rows, starts, want = [], {}, {}
    for k, (true, high) in enumerate((((60.0, 90.0, 0.16), (180.0, 900.0, 0.9)), ((60.0, 90.0, 0.16), (50.0, 900.0, 0.9)), ((20.0, 300.0, 0.3), (180.0, 100.0, 0.25)))):
        x = np.stack([rng.integers(1, 12, 400), rng.integers(0, 2, 400), rng.uniform(400, 9000, 400)], axis=1).astype(float)
        y, w, low, scale = x @ np.array(true) + rng.standard_t(1.5, 400) * 40, rng.integers(1, 4, 400), np.array([5.0, 0.0, 0.04]), 90.0
        rows += [(f"g{k}", *map(float, x[i]), float(y[i]), int(w[i])) for i in range(400)]
        starts[f"g{k}",] = {"x": (25.0, 60.0, 0.18), "low": tuple(low), "high": high, "scale": scale}

        def loss(p, x=x, y=y, w=w):
            return (w * (np.sqrt(1 + ((y - x @ p) / scale) ** 2) - 1)).sum()

        p, step = np.clip(np.array([100.0, 500.0, 0.5]), low, high), np.array([50.0, 200.0, 0.2])
        axes = [np.eye(3)[i] * s for i in range(3) for s in (1, -1)]
        while step.max() > 1e-12:  # moves along the axes, and along pairs that keep the mean residual
            moves = axes + [np.array([1.0, 0.0, -x[:, 0].mean() / x[:, 2].mean()]) * s for s in (1, -1)] + [np.array([0.0, 1.0, -0.5 / x[:, 2].mean()]) * s for s in (1, -1)]
            best = min((np.clip(p + m * step, low, high) for m in moves), key=loss)
            p, step = (best, step) if loss(best) < loss(p) else (p, step / 2)
        want[f"g{k}",] = p, loss
    df = spark.createDataFrame(rows, "k string, x0 double, x1 double, x2 double, y double, w long")
    got = speed.robust_fit(df, ["k"], starts)
    assert got.keys() == want.keys()
    for k, (p, loss) in want.items():
        assert loss(got[k]) <= loss(p) * (1 + 1e-12) and np.allclose(got[k], p, rtol=1e-3), (k, got[k], p)
    assert got["g1",][0] == 50.0 and got["g2",][2] == 0.25
    few = speed.robust_fit(df, ["k"], starts, passes=9)
    assert all(np.allclose(few[k], got[k], rtol=1e-6) for k in got)
    assert speed.robust_fit(df.limit(0), ["k"], starts)["g0",].tolist() == [25.0, 60.0, 0.18] and speed.robust_fit(df, ["k"], {}) == {}


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{k % 3}", float(rng.normal(0, 5)) if k % 3 else float(k % 4), int(rng.integers(-1, 5))) for k in range(900)] + [("null", None, 3), ("none", 2.0, 0), ("one", 2.5, 7), ("w", 1.0, None)]
    frame = spark.createDataFrame(rows, "k string, v double, w int")
    shares = (0.0, 0.3, 0.5, 1.0)
    got = {(r["k"], r["share"]): r["v"] for r in quantiles(frame, ["k"], "v", shares, weight="w").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        every = [v for key, v, n in rows if key == k and v is not None and n for _ in range(max(0, n))]
        want |= {(k, q): float(np.quantile(every, q)) for q in shares if every}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_bounded_least_squares():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
    low, high = np.array([-0.05, 0.0, -1.0]), np.array([0.05, 0.1, 1.0])
    got = speed.solved(x.T @ x, x.T @ y, low, high)
    grid = [np.clip(got + e, low, high) for e in rng.normal(scale=0.02, size=(300, 3))]
    assert all(((x @ got - y) ** 2).sum() <= ((x @ g - y) ** 2).sum() + 1e-9 for g in grid)


def test_choice(spark):
    options = spark.createDataFrame([("a", 1, 0.25), ("a", 2, 0.75), ("b", 1, 1.0)], "od string, rnk int, prob double")
    trips = spark.createDataFrame([("a", 0.2, None), ("a", 0.3, None), ("a", 0.3, 1), ("b", 0.99, None), ("c", 0.5, None)], "od string, u double, o int")
    got = [r["chosen"] for r in choice.assign(trips.coalesce(1), options, F.col("u"), F.col("o")).orderBy("od", "u", "o").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [1, 2, 1, 1, None]))
    shares = spark.range(20_000).select((choice.draw(42, "id") < 0.3).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(shares - 0.3) < 0.02


def test_departures_follow_the_headway(spark):
    lines = spark.createDataFrame([("L",)], "line string")
    hours = spark.createDataFrame([("L", h, 600.0 if h < 6 else 1205.0) for h in range(24)], "line string, hour int, headway_s double")
    t = [r["t"] for r in timetable.departures(lines, hours, service=(18000.0, 25200.0)).orderBy("k").collect()]
    assert t == [18000.0, 18600.0, 19200.0, 19800.0, 20400.0, 21000.0, 21600.0, 22810.0, 24020.0]


def test_departures_are_the_recurrence(spark):
    rng = np.random.default_rng(3)
    lines = {"none": {}, "odd": {h: [0.0, -5.0, 3.0, 10.0, 10.5, 3599.0, 5000.0][h % 7] for h in range(24)}, "gaps": {7: 605.0, 12: 1234.5}}
    lines |= {f"r{k}": {h: float(np.round(rng.uniform(5, 2500), 2)) for h in range(24)} for k in range(4)}
    headways = spark.createDataFrame([(k, h, v) for k, by in lines.items() for h, v in by.items()] + [("other", 5, 60.0), ("gaps", 9, None)], "line string, hour int, headway_s double")
    for service in ((18000.0, 84600.0), (20005.0, 100_000.0)):
        want = set()
        for line, by in lines.items():
            t, k, h = service[0], 0, by[min(by)] if by else None
            last = int(t // 3600)
            while by and t < service[1]:
                for hour in range(last, int(t // 3600) + 1):
                    h = by.get(hour % 24, h)
                last = int(t // 3600)
                want.add((line, k, t))
                due = -(-(t + h) // 10) * 10
                t, k = max(due, (t // 10 + 1) * 10), k + 1
        frame = timetable.departures(spark.createDataFrame([(k,) for k in lines], "line string"), headways, service=service)
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in frame.collect()} == want


def test_events_beyond_the_last_mark_and_trips_without_a_mode(spark):
    trips = spark.createDataFrame([(0.0, 60.0, "arrived"), (3600.0 * 60, 60.0, "arrived")], "departure_time double, total_time double, status string")
    last = metrics.hourly_snapshot(trips).where("hour = 48").first()
    assert (last["created"], last["arrived"], last["active"]) == (1, 1, 0)
    cmp = spark.createDataFrame([(m, 1.0 + k, 2.0 * k) for k in range(12) for m in ("bus", None)], "origin_mode string, sim_min double, obs_min double")
    assert {r["grp"]: r["n"] for r in validate.stats(cmp).collect()} == {"all": 24, "bus": 12, None: 12}


def test_several_service_days(spark, tmp_path):
    raw = []
    for day in ("2019-05-13", "2019-05-14"):
        for k in range(30):
            minute = f"{day} 08:{k * 2:02d}:0{k % 2}"
            raw.append((f"c{k}", "公交", "300路", f"Stop {k % 2}", 116.3, 39.9, minute, "公交", "300路", "End", 116.4, 39.95, f"{day} 09:30:00"))
    columns = "card string, o_mode string, o_line string, o_name string, o_lon double, o_lat double, dep string, d_mode string, d_line string, d_name string, d_lon double, d_lat double, arr string"
    taps = clean.clean_taps(spark.createDataFrame(raw, columns), date="day")
    assert {(r["day"], r["n"]) for r in taps.groupBy("day").agg(F.count("*").alias("n")).collect()} == {("2019-05-13", 30), ("2019-05-14", 30)}
    matched = taps.withColumns({"route_name": F.lit("L"), "o_key": F.concat(F.lit("bus:"), "o_name"), "d_key": F.lit("bus:End"), "same_line": F.lit(True)})
    both = headway.tap_clusters(matched, days=("day",))
    gaps = headway.cluster_gaps(both, days=("day",))
    by_hour = headway.bus_line_hour(gaps, both, days=("day",)).collect()
    one = headway.tap_clusters(matched.where("day = '2019-05-13'"))
    only = headway.bus_line_hour(headway.cluster_gaps(one), one).collect()
    assert both.count() == 2 * one.count() == 60 and gaps.count() == 2 * headway.cluster_gaps(one).count()
    assert [(r["hour"], r["headway_s"], r["n_obs"]) for r in by_hour] == [(r["hour"], r["headway_s"], 2 * r["n_obs"]) for r in only]
    known = spark.createDataFrame([("bus:Stop 0",), ("bus:Stop 1",), ("bus:End",)], "key string")
    trips = demand.convert(matched, known, F.col("day"))
    numbered = demand.with_sid(trips, ("date", "time", "pid"), written(tmp_path)).orderBy("sid").collect()
    assert [r["sid"] for r in numbered] == list(range(60)) and [r["date"] for r in numbered] == ["2019-05-13"] * 30 + ["2019-05-14"] * 30
