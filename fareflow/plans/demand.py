"""Queries of pruning and demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.operators import demand, prune
from fareflow.plans import base, taps  # noqa: F401
from fareflow.plans.registry import BLOCKS, KEYS, ora_haversine, ora_variant, query

MIN_TAPS, MIN_TRIPS = 400, 10
RULES = {"patterns": ("^地铁7号线",), "exclude": {"地铁3号线": ["东门25", "东门33"], "地铁5号线": ["东门41"]}, "passes": ("东门10", "东门12", "东门40", "东门36")}
_CLOSED = "(regexp_matches(route_name, '^地铁7号线') or (route_name like '地铁3号线%' and name in ('东门25', '东门33')) or (route_name like '地铁5号线%' and name in ('东门41')))"

BLOCKS |= {
    "station_evidence": f"""select key, name, coalesce(n, 0) as taps, coalesce(n, 0) >= {MIN_TAPS} or name in ('东门7') as kept from stations left join (
        select key, count(*) as n from (select o_key as key from matched where mode = 'subway' union all select d_key from matched where mode = 'subway') where key is not null group by key) using (key) where mode = 'subway'""",
    "line_evidence": f"""select route_name, r.key, cast(coalesce(n, 0) as bigint) as trips, coalesce(n, 0) >= {MIN_TRIPS} as kept from (select distinct route_name, {ora_variant('route_name')} as key from fx_edges where edge_type = 'bus') r
      left join (select {ora_variant('route_name')} as key, count(*) as n from matched where mode = 'bus' and route_name is not null group by 1) e on e.key = r.key""",
    "closed": f"select route_name, key, {_CLOSED} as closed from (select distinct route_name, f as key from ride_edges union select route_name, t from ride_edges) join stations using (key)",
    "statuses": """select c.route_name, c.key, case when s.mode = 'subway' then case when closed then 'cut' when coalesce(e.kept, false) then 'keep' when s.name in ('东门10', '东门12', '东门40', '东门36') then 'pass' else 'cut' end
        when coalesce(l.kept, false) then 'keep' else 'cut' end as status
      from closed c join stations s using (key) left join station_evidence e using (key) left join line_evidence l on l.route_name = c.route_name""",
    "runs": """select case when max(kr) over (partition by route_name) > 1 then concat(route_name, '_seg', kr) else route_name end as route_name, seq, from_key, to_key, distance, travel_time
      from (select *, dense_rank() over (partition by route_name order by island) as kr
        from (select route_name, island, seq, lag(key) over w as from_key, key as to_key, cd - lag(cd) over w as distance, ct - lag(ct) over w as travel_time
          from (select *, min(case when k = 0 and status = 'keep' then seq * 2 + k end) over (partition by route_name, island) as start
            from (select *, sum(cast(status = 'cut' as int)) over o as island, sum(d) over o as cd, sum(tt) over o as ct
              from (select e.route_name, e.seq, e.k, e.key, e.d, e.tt, coalesce(s.status, 'cut') as status
                from (select route_name, seq, unnest([0, 1]) as k, unnest([f, t]) as key, unnest([0.0, distance]) as d, unnest([0.0, travel_time]) as tt from ride_edges) e
                left join statuses s on s.route_name = e.route_name and s.key = e.key) window o as (partition by route_name order by seq, k)))
          where status = 'keep' and (seq * 2 + k = start or (k = 1 and seq * 2 + k > start)) window w as (partition by route_name, island order by seq, k)) where from_key is not null)""",
    "kept_nodes": "select * from stations where key in (select from_key from runs union select to_key from runs)",
    "kept_transfers": """select distinct seq, edge_type, from_id, to_id, distance from fx_edges join (values ('bus_transfer', 'bus', 'bus'), ('subway_transfer', 'subway', 'subway'), ('intermodal_transfer', 'subway', 'bus'), ('intermodal_transfer', 'bus', 'subway')) v(ty, a, b) on edge_type = ty
      where concat(a, ':', from_id) in (select key from kept_nodes) and concat(b, ':', to_id) in (select key from kept_nodes)""",
    "demand": f"""select card as pid, concat(cast(round(o_lon, 2) as varchar), ',', cast(round(o_lat, 2) as varchar)) as o, concat(cast(round(d_lon, 2) as varchar), ',', cast(round(d_lat, 2) as varchar)) as d, o_lon, o_lat, d_lon, d_lat,
        '2019-05-13' as date, cast(dep_s as int) as time, split_part(o_key, ':', 2) as origin_id, split_part(o_key, ':', 1) as origin_type, split_part(d_key, ':', 2) as destination_id, split_part(d_key, ':', 1) as destination_type,
        round({ora_haversine('o_lat', 'o_lon', 'd_lat', 'd_lon')} / 1000, 6) as distance, tt_adj_s as observed_tt_s, line_raw as o_line, same_line, route_name, {KEYS}
      from matched where o_key <> d_key and o_key in (select key from stations) and d_key in (select key from stations)""",
}


def evidence(spark, sf):
    return prune.station_evidence(base.matched(spark, sf), base.known(spark, sf), MIN_TAPS, ("东门7",))


def status(spark, sf):
    edges = base.edges(spark, sf)
    lines = prune.line_evidence(base.matched(spark, sf), edges, MIN_TRIPS)
    return prune.statuses(edges, base.known(spark, sf), evidence(spark, sf), lines, **RULES)


@base.shared
def runs(spark, sf):
    return prune.line_runs(base.edges(spark, sf), status(spark, sf))


@query("prune_station_evidence", "select * from station_evidence")
def prune_station_evidence(spark, sf):
    return evidence(spark, sf)


@query("prune_line_evidence", "select * from line_evidence")
def prune_line_evidence(spark, sf):
    return prune.line_evidence(base.matched(spark, sf), base.edges(spark, sf), MIN_TRIPS)


@query("prune_closed_lines", "select * from closed")
def prune_closed_lines(spark, sf):
    return prune.closed_lines(base.edges(spark, sf), base.known(spark, sf), RULES["patterns"], RULES["exclude"])


@query("prune_line_runs", "select route_name, seq, from_key, to_key, round(distance, 6) as distance, round(travel_time, 6) as travel_time from runs")
def prune_line_runs(spark, sf):
    return runs(spark, sf).withColumns({c: F.round(c, 6) for c in ("distance", "travel_time")})


@query("prune_nodes", "select * from kept_nodes")
def prune_nodes(spark, sf):
    return prune.kept_nodes(base.known(spark, sf), runs(spark, sf))


@query("prune_transfers", "select * from kept_transfers")
def prune_transfers(spark, sf):
    return prune.kept_transfers(base.edges(spark, sf), prune.kept_nodes(base.known(spark, sf), runs(spark, sf)))


@query("prune_report", """select (select count(*) from stations) as nodes_before, (select count(*) from kept_nodes) as nodes_after, (select count(*) from fx_edges) as edges_before,
  (select count(*) from runs) + (select count(*) from kept_transfers) as edges_after, (select coalesce(string_agg(key, ',' order by key), '') from stations where key not in (select key from kept_nodes)) as dropped""")
def prune_report(spark, sf):
    known, edges = base.known(spark, sf), base.edges(spark, sf)
    kept = prune.kept_nodes(known, runs(spark, sf))
    return prune.prune_report(known, edges, kept, runs(spark, sf), prune.kept_transfers(edges, kept))


def trips(spark, sf):
    """Not written, as few queries need all columns."""
    return demand.convert(base.matched(spark, sf), base.known(spark, sf), keep=base.ROW)


@base.shared
def od(spark, sf):
    """The pairs of stops of all trips."""
    return demand.od_pairs(trips(spark, sf))


ORDER = ("time", "pid", *base.ROW)


@query("demand_convert", "select * from demand")
def demand_convert(spark, sf):
    return trips(spark, sf).withColumn("distance", F.round("distance", 6))


@query("demand_sid", f"select row_number() over (order by time, pid, {KEYS}) - 1 as sid, time, pid, {KEYS} from demand")
def demand_sid(spark, sf):
    return demand.with_sid(trips(spark, sf), ("date", *ORDER), base.cut).select("sid", *ORDER)


@query("demand_report", """select (select count(*) from matched) as matched_records, (select count(*) from matched where o_key <> d_key) as both_nodes, count(*) as output_rows, count(*) filter (origin_type = 'bus') as bus,
  count(*) filter (origin_type = 'subway') as subway, round(avg(observed_tt_s / 60), 6) as mean_minutes, count(distinct (origin_type, origin_id, destination_type, destination_id)) as od_pairs from demand""")
def demand_report(spark, sf):
    return demand.convert_report(base.matched(spark, sf), trips(spark, sf)).withColumn("mean_minutes", F.round("mean_minutes", 6))


@query("demand_hourly_profile", """select cast(h as int) as hour, coalesce(n, 0) as trips, coalesce(s, 0) as subway, coalesce(b, 0) as bus, round(coalesce(n, 0) / greatest((select count(*) from demand), 1), 9) as share from range(0, 24) r(h)
  left join (select least(greatest(cast(floor(time / 3600) as int), 0), 23) as hh, count(*) as n, count(*) filter (origin_type = 'subway') as s, count(*) filter (origin_type = 'bus') as b from demand group by 1) on hh = h""")
def demand_hourly_profile(spark, sf):
    return demand.hourly_profile(trips(spark, sf)).withColumn("share", F.round("share", 9))


@query("demand_quarter_profile", "select cast(floor(time / 900) as bigint) as slot, count(*) as trips, cast(floor(time / 900) * 900 as bigint) as start_s from demand group by all")
def demand_quarter_profile(spark, sf):
    return demand.quarter_hour_profile(trips(spark, sf))


@query("demand_window", f"select time, origin_id, destination_id, {KEYS} from demand where time >= 21600 and time < 36000 and origin_id <> destination_id")
def demand_window(spark, sf):
    return demand.window(trips(spark, sf), 21600, 36000).select("time", "origin_id", "destination_id", *base.ROW)


@query("demand_sample", "select cast(round_even(count(*) * 0.05, 0) as bigint) as n from demand")
def demand_sample(spark, sf):
    return demand.sample(trips(spark, sf), 0.05, ORDER).agg(F.count("*").alias("n"))


@query("demand_buckets", "select cast(floor(time / 10) * 10 as bigint) as bucket, concat(origin_type, ':', origin_id) as origin, concat(destination_type, ':', destination_id) as destination, count(*) as trips from demand group by all")
def demand_buckets(spark, sf):
    return demand.buckets(trips(spark, sf))


@query("demand_od_pairs", """select distinct concat(origin_type, ':', origin_id) as origin, concat(destination_type, ':', destination_id) as destination from demand where concat(origin_type, ':', origin_id) <> concat(destination_type, ':', destination_id)
  and not exists (from (select distinct origin_type as ot, origin_id as oi, destination_type as dt, destination_id as di from demand where time < 28800) k where k.ot = origin_type and k.oi = origin_id and k.dt = destination_type and k.di = destination_id)""")
def demand_od_pairs(spark, sf):
    all_trips = trips(spark, sf)
    return demand.od_pairs(all_trips, demand.od_pairs(all_trips.where("time < 28800")))


@query("demand_hourly_counts", "select cast(floor(time / 3600) as int) as hour, count(*) as trips from demand group by 1")
def demand_hourly_counts(spark, sf):
    return demand.hourly_counts(trips(spark, sf))
