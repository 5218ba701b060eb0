"""Queries of headways, trip metrics and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.functions.columns import period
from fareflow.operators import headway, metrics, validate
from fareflow.params import PERIOD_HOURS
from fareflow.plans import base, taps  # noqa: F401
from fareflow.plans.registry import BLOCKS, ora_period, query
from fareflow.sources import fixtures


def rounded(df, *skip, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double" and c not in skip})


_PH = ", ".join(f"({p!r}, '{h}')" for p, hs in PERIOD_HOURS.items() for h in hs)
BLOCKS |= {
    "top_stops": """select * from (select route_name, o_key, count(*) as taps, row_number() over (partition by route_name order by count(*) desc, o_key) as rank from matched
      where mode = 'bus' and route_name is not null and o_key is not null group by route_name, o_key having count(*) >= 40) where rank <= 6""",
    "clusters": """select route_name, o_key, cluster, median(dep_s) as center, count(*) as taps from (select route_name, o_key, dep_s, sum(b) over (partition by route_name, o_key order by dep_s rows unbounded preceding) as cluster
      from (select m.route_name, m.o_key, dep_s, case when dep_s - lag(dep_s) over (partition by m.route_name, m.o_key order by dep_s) <= 90 then 0 else 1 end as b from matched m join top_stops s on s.route_name = m.route_name and s.o_key = m.o_key where m.mode = 'bus')) group by all""",
    "gaps": """select route_name, o_key, hour, gap from (select *, count(*) over (partition by route_name, o_key, hour) as n from (select route_name, o_key, cast(floor(center / 3600) as int) % 24 as hour,
      lead(center) over (partition by route_name, o_key order by cluster) - center as gap from clusters) where gap is not null) where n >= 2 and gap between 60 and 3600""",
    "line_hour": """select g.route_name, g.hour, median(gap) as median_gap_s, count(*) as n_obs, 3600.0 / greatest(coalesce(any_value(most), 1), 1) as upper_from_clusters_s, least(median(gap), greatest(3600.0 / greatest(coalesce(any_value(most), 1), 1), 60.0)) as headway_s
      from gaps g left join (select route_name, hour, max(n) as most from (select route_name, o_key, cast(floor(center / 3600) as int) % 24 as hour, count(*) as n from clusters c
        where (select count(*) from clusters x where x.route_name = c.route_name and x.o_key = c.o_key) >= 2 group by all) group by all) m on m.route_name = g.route_name and m.hour = g.hour group by g.route_name, g.hour having count(*) >= 2""",
    "bus_mode": """select hour, min(headway_s) filter (cw >= 0.5 * total) as headway_s, cast(max(total) as bigint) as n_obs from (select hour, headway_s, sum(w) over (partition by hour order by headway_s) as cw, sum(w) over (partition by hour) as total
      from (select hour, headway_s, sum(n_obs) as w from (select cast(hour as varchar) as hour, headway_s, n_obs from line_hour union all select 'all', headway_s, n_obs from line_hour) group by all)) group by hour""",
    "subway_fits": f"""select case when key = 'subway' then 'mode' else 'line' end as scope, key, period, round(avg(tt_adj_s), 3) as intercept_s, 35.0 as dwell_s, count(*) as n_obs
      from (select unnest(['subway', route_name]) as key, unnest(['all', {ora_period('((dep_s % 86400) / 3600.0)')}]) as period, * exclude (o_key) from matched where mode = 'subway' and route_name is not null) group by all""",
    "subway_headways": f"""select scope, key, coalesce(h.hour, 'all') as hour, hw as headway_s, least(greatest(intercept_s - dwell_s - hw / 2, 60.0), 900.0) as access_egress_s, n_obs, 'subway_prior' as method
      from (select *, case f.period when 'am_peak' then 180.0 when 'pm_peak' then 180.0 when 'off_peak' then 360.0 when 'night' then 480.0 else 300.0 end as hw from subway_fits f) f left join (values {_PH}) h(period, hour) on h.period = f.period""",
    "cmp": "select *, case when origin_mode = 'bus' then total_time - first_wait_time else total_time end / 60 as sim_min, observed_tt_s / 60 as obs_min from fx_trips where status = 'arrived' and observed_tt_s is not null",
    "cmp_all": "select 'all' as grp, * from cmp union all select origin_mode, * from cmp",
    "dist": """select grp, x, sum(ns) over (partition by grp order by x) / sum(ns) over (partition by grp) as f_sim, sum(no) over (partition by grp order by x) / sum(no) over (partition by grp) as f_obs
      from (select grp, x, sum(s) as ns, sum(1 - s) as no from (select grp, sim_min as x, 1 as s from cmp_all union all select grp, obs_min, 0 from cmp_all) group by all)""",
}


@base.shared
def clusters(spark, sf):
    matched = base.matched(spark, sf)
    busy = headway.top_stops(matched).select("route_name", "o_key")
    return headway.tap_clusters(matched.where("mode = 'bus'").join(busy, ["route_name", "o_key"], "left_semi"))


def line_hour(spark, sf):
    found = clusters(spark, sf)
    return headway.bus_line_hour(headway.cluster_gaps(found), found)


def subway_fits(spark, sf):
    """Stand-in fits from the taps themselves: mean times by mode and line, so that the comparison needs no regression."""
    rides = base.matched(spark, sf).where("mode = 'subway' and route_name is not null")
    keys = F.explode(F.arrays_zip(F.array(F.lit("subway"), "route_name").alias("key"), F.array(F.lit("all"), period(F.col("dep_s"))).alias("period"))).alias("k")
    by = rides.select(keys, "tt_adj_s").groupBy("k.key", "k.period").agg(F.round(F.avg("tt_adj_s"), 3).alias("intercept_s"), F.count("*").alias("n_obs"))
    return by.select(F.when(F.col("key") == "subway", "mode").otherwise("line").alias("scope"), "key", "period", "intercept_s", F.lit(35.0).alias("dwell_s"), "n_obs")


@query("headway_top_stops", "select * from top_stops")
def headway_top_stops(spark, sf):
    return headway.top_stops(base.matched(spark, sf))


@query("headway_tap_clusters", "select * replace (cast(cluster as bigint) as cluster) from clusters")
def headway_tap_clusters(spark, sf):
    return clusters(spark, sf)


@query("headway_cluster_gaps", "select * from gaps")
def headway_cluster_gaps(spark, sf):
    return headway.cluster_gaps(clusters(spark, sf))


@query("headway_bus_line_hour", "select route_name, hour, round(median_gap_s, 6) as median_gap_s, n_obs, round(upper_from_clusters_s, 6) as upper_from_clusters_s, round(headway_s, 6) as headway_s from line_hour")
def headway_bus_line_hour(spark, sf):
    return rounded(line_hour(spark, sf))


@query("headway_bus_mode", "select hour, round(headway_s, 6) as headway_s, n_obs from bus_mode")
def headway_bus_mode(spark, sf):
    return rounded(headway.bus_mode(line_hour(spark, sf)))


@query("headway_access_egress", """select unnest(cast([0.02, 0.05, 0.08, 0.1, 0.25, 0.5] as double[])) as q, unnest(list_transform(quantile_cont(r, [0.02, 0.05, 0.08, 0.1, 0.25, 0.5]), lambda x: round(x, 6))) as seconds
  from (select tt_adj_s - route_dist_m / (35.0 / 3.6) - 35.0 as r from matched where mode = 'subway' and same_line and n_intermediate = 0 and route_dist_m > 300) where r > 0 and r < 3600""")
def headway_access_egress(spark, sf):
    return rounded(headway.access_egress(base.matched(spark, sf), 35.0, 35.0), "q")


@query("headway_subway", "select scope, key, hour, cast(headway_s as double) as headway_s, round(access_egress_s, 6) as access_egress_s, n_obs, method from subway_headways")
def headway_subway(spark, sf):
    return rounded(headway.subway(subway_fits(spark, sf), 120.0))


@query("headway_table", """select 'mode' as scope, 'bus' as key, hour, round(headway_s, 6) as headway_s, n_obs, 'bus_tapin_clusters' as method, cast(null as double) as median_gap_s, cast(null as double) as upper_from_clusters_s from bus_mode
  union all select 'line', route_name, cast(hour as varchar), round(headway_s, 6), n_obs, 'bus_tapin_clusters', round(median_gap_s, 6), round(upper_from_clusters_s, 6) from line_hour
  union all select scope, key, hour, headway_s, n_obs, method, null, null from subway_headways""")
def headway_table(spark, sf):
    lines = line_hour(spark, sf)
    return rounded(headway.headway_table(headway.bus_mode(lines), lines, headway.subway(subway_fits(spark, sf), 120.0)))


# ---- trip metrics


def trips(spark, sf):
    return fixtures.load(spark, sf, "fx_trips")


@query("trip_records", f"""select sid as passenger_id, sid, concat('p', cast(sid as varchar)) as pid, concat('S', cast(sid % 60 as varchar)) as origin, cast(null as varchar) as destination, origin_mode, origin_mode as destination_mode,
  departure_time, case when status = 'arrived' then departure_time + total_time end as arrival_time, status, wait_time, first_wait_time, walk_time, in_vehicle_time, cast(0 as double) as access_egress_time,
  cast(num_transfers as int) + 1 as num_boardings, cast(0 as int) as mode_type, in_vehicle_time / 100 as route_distance_km, cast(0 as int) as num_reroutes, observed_tt_s,
  case when status = 'arrived' then total_time else 108000.0 - departure_time end as total_time, cast(floor(departure_time / 3600) as int) % 24 as departure_hour, cast(num_transfers as int) as num_transfers,
  case when sid % 7 = 0 then 'Walk' when sid % 3 = 0 then 'Subway' else 'Bus' end as main_mode from fx_trips""")
def trip_records(spark, sf):
    sid = F.col("sid")
    several = F.when(sid % 7 == 0, F.array().cast("array<string>")).when(sid % 3 == 0, F.array(F.lit("bus"), F.lit("subway"))).when(sid % 3 == 1, F.array(F.lit("bus"), F.lit("bus"), F.lit("subway"))).otherwise(F.array(F.lit("bus")))
    events = trips(spark, sf).select(
        "sid", sid.alias("passenger_id"), F.concat(F.lit("p"), sid.cast("string")).alias("pid"), F.concat(F.lit("S"), (sid % 60).cast("string")).alias("origin"), "origin_mode", F.col("origin_mode").alias("destination_mode"), "departure_time",
        F.when(F.col("status") == "arrived", F.col("departure_time") + F.col("total_time")).alias("arrival_time"), "status", "wait_time", "first_wait_time", "walk_time", "in_vehicle_time",
        (F.col("num_transfers") + 1).alias("num_boardings"), (F.col("in_vehicle_time") / 100).alias("route_distance_km"), "observed_tt_s", several.alias("edge_modes"))
    return metrics.trip_records(events, 108000)


@query("trip_main_mode", """select l_orderkey, case when s >= b and s > 0 then 'Subway' when b > 0 then 'Bus' else 'Walk' end as main_mode
  from (select l_orderkey, count(*) filter (l_partkey % 3 = 0) as s, count(*) filter (l_partkey % 3 = 1) as b from lineitem group by 1)""")
def trip_main_mode(spark, sf):
    edge = F.when(F.col("l_partkey") % 3 == 0, "subway").when(F.col("l_partkey") % 3 == 1, "bus").otherwise("walk")
    routes = fixtures.given(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(edge).alias("modes"))
    return routes.select("l_orderkey", metrics.main_mode(F.col("modes")).alias("main_mode"))


def _three(c, name):
    return f"round(avg({c} / 60) filter (status = 'arrived'), 6) as {name}_mean, round(median({c} / 60) filter (status = 'arrived'), 6) as {name}_median, round(quantile_cont({c} / 60, 0.9) filter (status = 'arrived'), 6) as {name}_p90"


@query("trip_summary", f"""select count(*) as n, count(*) filter (status = 'arrived') as arrived, count(*) filter (status = 'timeout_exit') as timeout_exit, count(*) filter (status = 'unfinished') as unfinished,
  {_three('total_time', 'total')}, {_three('wait_time', 'wait')}, {_three('walk_time', 'walk')}, {_three('in_vehicle_time', 'ivt')}, round(avg(num_transfers) filter (status = 'arrived'), 6) as mean_transfers,
  round(count(*) filter (status = 'arrived') / greatest(count(*), 1), 6) as completion_rate from fx_trips""")
def trip_summary(spark, sf):
    return rounded(metrics.summary(trips(spark, sf)))


@query("trip_by_main_mode", """select main_mode, count(*) as n, round(avg(total_time / 60), 6) as total_mean, round(median(total_time / 60), 6) as total_median, round(avg(in_vehicle_time / 60), 6) as ivt_mean,
  round(avg(wait_time / 60), 6) as wait_mean, round(avg(num_transfers), 6) as mean_transfers from fx_trips where status = 'arrived' group by main_mode""")
def trip_by_main_mode(spark, sf):
    return rounded(metrics.by_main_mode(trips(spark, sf)))


@query("trip_vs_observed", """select count(*) as n, round(avg(total_time / 60), 6) as sim_mean, round(avg(observed_tt_s / 60), 6) as obs_mean, round(avg(abs(total_time - observed_tt_s) / 60), 6) as mae from fx_trips where status = 'arrived' and observed_tt_s is not null""")
def trip_vs_observed(spark, sf):
    return rounded(metrics.vs_observed(trips(spark, sf)))


@query("trip_hourly_snapshot", """select cast(h as int) as hour, count(*) filter (departure_time <= h * 3600) as created, count(*) filter (status = 'arrived' and departure_time + total_time <= h * 3600) as arrived,
  count(*) filter (status = 'timeout_exit' and departure_time + total_time <= h * 3600) as timed_out,
  count(*) filter (departure_time <= h * 3600) - count(*) filter (status in ('arrived', 'timeout_exit') and departure_time + total_time <= h * 3600) as active from range(0, 49) r(h), fx_trips group by h""")
def trip_hourly_snapshot(spark, sf):
    return metrics.hourly_snapshot(trips(spark, sf))


def cmp(spark, sf):
    return validate.comparable(trips(spark, sf))


@query("valid_comparable", "select sid, origin_mode, round(sim_min, 6) as sim_min, round(obs_min, 6) as obs_min from cmp")
def valid_comparable(spark, sf):
    return rounded(cmp(spark, sf).select("sid", "origin_mode", "sim_min", "obs_min"))


_STATS = """count(*) as n, round(avg(sim_min - obs_min), 6) as mean_error, round(avg(abs(sim_min - obs_min)), 6) as mae, round(sqrt(avg((sim_min - obs_min) * (sim_min - obs_min))), 6) as rmse, round(corr(sim_min, obs_min), 6) as corr,
  round(avg(sim_min), 6) as sim_mean, round(median(sim_min), 6) as sim_median, round(quantile_cont(sim_min, 0.9), 6) as sim_p90, round(avg(obs_min), 6) as obs_mean, round(median(obs_min), 6) as obs_median, round(quantile_cont(obs_min, 0.9), 6) as obs_p90"""


@query("valid_stats", f"select grp, {_STATS} from cmp_all group by grp having count(*) >= 10")
def valid_stats(spark, sf):
    return rounded(validate.stats(cmp(spark, sf)))


@query("valid_ks", "select grp, round(max(abs(f_sim - f_obs)), 6) as ks from dist group by grp")
def valid_ks(spark, sf):
    return rounded(validate.ks(cmp(spark, sf)))


@query("valid_wasserstein", "select grp, round(sum(abs(f_sim - f_obs) * w), 6) as wasserstein from (select *, lead(x) over (partition by grp order by x) - x as w from dist) group by grp")
def valid_wasserstein(spark, sf):
    return rounded(validate.wasserstein(cmp(spark, sf)))


@query("valid_hourly", """select origin_mode, departure_hour, count(*) as n, round(avg(sim_min), 6) as sim_mean, round(median(sim_min), 6) as sim_median, round(avg(obs_min), 6) as obs_mean, round(median(obs_min), 6) as obs_median from cmp group by 1, 2""")
def valid_hourly(spark, sf):
    return rounded(validate.hourly(cmp(spark, sf)))


@query("valid_cdf", """select origin_mode, series, round(x, 6) as x, round(sum(n) over (partition by origin_mode, series order by x) / sum(n) over (partition by origin_mode, series), 6) as p
  from (select origin_mode, series, x, count(*) as n from (select origin_mode, 'sim' as series, sim_min as x from cmp union all select origin_mode, 'obs', obs_min from cmp) group by all)""")
def valid_cdf(spark, sf):
    return rounded(validate.cdf(cmp(spark, sf)))


@query("valid_density", "select cast(floor(obs_min) as bigint) as obs_bin, cast(floor(sim_min) as bigint) as sim_bin, count(*) as n from cmp group by all")
def valid_density(spark, sf):
    return validate.density(cmp(spark, sf))


@query("valid_scenarios", """select a.grp, a.n as n_calibrated, round(a.mae, 6) as mae_calibrated, round(a.rmse, 6) as rmse_calibrated, round(a.m, 6) as sim_mean_calibrated, b.n as n_legacy, round(b.mae, 6) as mae_legacy, round(b.rmse, 6) as rmse_legacy, round(b.m, 6) as sim_mean_legacy
  from (select grp, count(*) as n, avg(abs(sim_min - obs_min)) as mae, sqrt(avg(power(sim_min - obs_min, 2))) as rmse, avg(sim_min) as m from cmp_all group by grp) a
  join (select grp, count(*) as n, avg(abs(sim_min * 0.8 - obs_min)) as mae, sqrt(avg(power(sim_min * 0.8 - obs_min, 2))) as rmse, avg(sim_min * 0.8) as m from cmp_all group by grp) b using (grp)""")
def valid_scenarios(spark, sf):
    a = cmp(spark, sf)
    return rounded(validate.scenarios(a, a.withColumn("sim_min", F.col("sim_min") * 0.8)))


@query("calib_parameters", """select key as mode, unnest(['speed_kmh', 'dwell_s', 'stop_delay_s', 'terminal_hold_s']) as name, unnest([x.s, x.d, x.y, x.h]) as value from speeds where scope = 'mode' and period = 'all'
  union all select key, concat('headway_s_', hour), headway_s from headways where scope = 'mode' and hour <> 'all'
  union all select key, 'transfer_time_s', transfer_time_s from transfers_table where scope = 'mode'""")
def calib_parameters(spark, sf):
    return validate.calib_parameters(taps.speeds(spark, sf), taps.headways(spark, sf), fixtures.load(spark, sf, "transfers_table"))
