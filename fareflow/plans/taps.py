"""Queries of cleaning, scalar functions, network tables and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow import params
from fareflow.functions import columns as C
from fareflow.operators import clean, matching, network
from fareflow.plans import base
from fareflow.plans.registry import (
    BLOCKS, BOX, KEYS, THERE, VALID, ora_core, ora_given, ora_haversine, ora_period, ora_station, ora_variant, query)
from fareflow.sources import fixtures

ROW = base.ROW
_RAW = "card, o_mode, d_mode, o_line, d_line, o_dir, o_stopno, d_stopno, o_name, d_name, o_lat, o_lon, d_lat, d_lon, dep, arr"


@query("tap_drop_missing", f"select {_RAW}, {KEYS} from fx_taps where {THERE}")
def tap_drop_missing(spark, sf):
    return clean.drop_missing(base.raw(spark, sf))


@query("tap_bbox", f"select {_RAW}, {KEYS} from fx_taps where {BOX}")
def tap_bbox(spark, sf):
    return clean.in_bbox(base.raw(spark, sf))


@query("tap_times", f"select {KEYS}, dep_s, arr_s, tt_s from timed")
def tap_times(spark, sf):
    return clean.with_times(clean.in_bbox(clean.drop_missing(base.raw(spark, sf)))).select(*ROW, "dep_s", "arr_s", "tt_s")


@query("tap_valid", f"select {KEYS}, case o_mode when '公交' then 'bus' else 'subway' end as mode, tt_s from timed where {VALID}")
def tap_valid(spark, sf):
    timed = clean.with_times(clean.in_bbox(clean.drop_missing(base.raw(spark, sf))))
    return clean.valid_trips(timed).select(*ROW, "mode", "tt_s")


@query("tap_clean", "select * from clean")
def tap_clean(spark, sf):
    return base.taps(spark, sf)


@query("tap_funnel", f"""select (select count(*) from fx_taps) as rows_read, (select count(*) from fx_taps where {THERE} and {BOX}) as in_bbox,
  (select count(*) from clean) as valid_time, (select count(*) from clean) as kept""")
def tap_funnel(spark, sf):
    return clean.funnel(base.raw(spark, sf))


@query("tap_adjust_tt", f"select {KEYS}, mode, tt_s, tt_adj_s from clean")
def tap_adjust_tt(spark, sf):
    return base.taps(spark, sf).select(*ROW, "mode", "tt_s", "tt_adj_s")


# ---- scalar functions over whole columns of the mapped tables


@query("fn_haversine", f"select {KEYS}, round({ora_haversine('o_lat', 'o_lon', 'd_lat', 'd_lon')}, 3) as m from fx_taps where o_lat is not null")
def fn_haversine(spark, sf):
    far = C.haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    return base.raw(spark, sf).where("o_lat is not null").select(*ROW, F.round(far, 3).alias("m"))


def _names(spark, sf):
    return fixtures.load(spark, sf, "fx_names")


@query("fn_station_name", f"select distinct station, {ora_station('station')} as norm from fx_names")
def fn_station_name(spark, sf):
    return _names(spark, sf).select("station", C.station_name(F.col("station")).alias("norm")).distinct()


@query("fn_line_variant", f"select distinct line_name, {ora_variant('line_name')} as key from fx_names")
def fn_line_variant(spark, sf):
    return _names(spark, sf).select("line_name", C.line_variant_key(F.col("line_name")).alias("key")).distinct()


@query("fn_line_core", f"select distinct line_name, {ora_core('line_name')} as key from fx_names")
def fn_line_core(spark, sf):
    return _names(spark, sf).select("line_name", C.line_core_key(F.col("line_name")).alias("key")).distinct()


def _ora_bus(c):
    return f"replace(regexp_replace(regexp_replace({ora_given(c)}, '{params.BRACKETS}', '', 'g'), '(路|线)$', ''), '路', '')"


@query("fn_bus_core", f"""select distinct line_name, coalesce(nullif(regexp_replace({_ora_bus('line_name')}, '{params.BUS_ENDS}', ''), ''), {_ora_bus('line_name')}) as key from fx_names""")
def fn_bus_core(spark, sf):
    return _names(spark, sf).select("line_name", C.bus_core(F.col("line_name")).alias("key")).distinct()


@query("fn_bus_variant", f"select distinct line_name, nullif({_ora_bus('line_name')}, '') as key from fx_names")
def fn_bus_variant(spark, sf):
    return _names(spark, sf).select("line_name", C.bus_variant(F.col("line_name")).alias("key")).distinct()


@query("fn_route_terminals", rf"""select distinct line_name, case when regexp_matches(line_name, p) then regexp_extract(line_name, p, 1) else line_name end as name,
  case when regexp_matches(line_name, p) then regexp_extract(line_name, p, 2) end as first, case when regexp_matches(line_name, p) then regexp_extract(line_name, p, 3) end as last
  from (select *, '{params.TERMINALS}' as p from fx_names)""")
def fn_route_terminals(spark, sf):
    return _names(spark, sf).select("line_name", C.route_terminals(F.col("line_name")).alias("x")).select("line_name", "x.name", "x.first", "x.last").distinct()


@query("fn_node_key", "select distinct concat(mode, ':', o_name) as key, mode, o_name as raw from clean")
def fn_node_key(spark, sf):
    keyed = base.taps(spark, sf).select(C.node_key(F.col("mode"), F.col("o_name")).alias("key")).distinct()
    return keyed.select("key", C.split_node_key(F.col("key")).alias("x")).select("key", "x.mode", "x.raw")


@query("fn_period", f"select {KEYS}, {ora_period('((dep_s % 86400) / 3600.0)')} as period from clean")
def fn_period(spark, sf):
    return base.taps(spark, sf).select(*ROW, C.period(F.col("dep_s")).alias("period"))


@query("fn_hour_hms", f"""select {KEYS}, cast(floor((arr_s % 86400) / 3600) as int) as hour,
  concat_ws(':', lpad(cast(cast(floor(arr_s / 3600) as int) as varchar), 2, '0'), lpad(cast(cast(floor((arr_s % 3600) / 60) as int) as varchar), 2, '0'), lpad(cast(cast(arr_s % 60 as int) as varchar), 2, '0')) as hms from clean""")
def fn_hour_hms(spark, sf):
    return base.taps(spark, sf).select(*ROW, C.hour_of(F.col("arr_s")).alias("hour"), C.fmt_hms(F.col("arr_s")).alias("hms"))


@query("fn_od_cell", f"select {KEYS}, concat(cast(round(o_lon, 2) as varchar), ',', cast(round(o_lat, 2) as varchar)) as o, concat(cast(round(d_lon, 2) as varchar), ',', cast(round(d_lat, 2) as varchar)) as d from clean")
def fn_od_cell(spark, sf):
    return base.taps(spark, sf).select(*ROW, C.od_cell(F.col("o_lon"), F.col("o_lat")).alias("o"), C.od_cell(F.col("d_lon"), F.col("d_lat")).alias("d"))


@query("fn_time_bucket", f"select {KEYS}, cast(floor(dep_s / 10) * 10 as bigint) as bucket from clean")
def fn_time_bucket(spark, sf):
    return base.taps(spark, sf).select(*ROW, C.time_bucket(F.col("dep_s")).alias("bucket"))


@query("fn_effective_capacity", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(greatest(1, round_even(l_quantity * 0.05, 0)) as int) as capacity from lineitem")
def fn_effective_capacity(spark, sf):
    rows = fixtures.given(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", C.effective_capacity(F.col("l_quantity"), F.lit(0.05)).alias("capacity"))


# ---- network tables. Calibrated values come from the given tables, too.

BLOCKS |= {
    "walk": """select f, t, arg_min(kind, r) as kind, arg_min(time, r) as time from (select concat(a, ':', from_id) as f, concat(b, ':', to_id) as t, edge_type as kind, coalesce(distance, 0) / 1.2 as time, [rk, seq, turn] as r
        from fx_edges join (values ('bus_transfer', 'bus', 'bus', 0, 0), ('subway_transfer', 'subway', 'subway', 1, 0), ('intermodal_transfer', 'subway', 'bus', 2, 0), ('intermodal_transfer', 'bus', 'subway', 2, 1)) v(ty, a, b, rk, turn) on edge_type = ty)
      where f <> t and f in (select key from stations) and t in (select key from stations) group by f, t""",
    "speeds_table": """select case when n_nationkey % 3 = 0 then 'mode' else 'line' end as scope, case when n_nationkey % 3 = 0 then case when n_nationkey % 2 = 0 then 'bus' else 'subway' end else route_name end as key,
        case n_nationkey % 4 when 0 then 'all' when 1 then 'am_peak' when 2 then 'off_peak' else 'night' end as period, case when n_nationkey % 5 = 4 then 0.0 else 20.0 + n_nationkey end as speed_kmh,
        case when n_nationkey % 7 = 0 then null else 20.0 + n_nationkey % 9 end as dwell_s, cast(n_nationkey % 6 as double) as stop_delay_s, cast(n_nationkey % 5 * 10 as double) as terminal_hold_s, n_nationkey as seq
      from nation join (select distinct line_no, route_name from fx_line_stop) ls on ls.line_no = n_nationkey""",
    "headways_table": """select case when n_nationkey % 4 = 0 then 'mode' else 'line' end as scope, case when n_nationkey % 4 = 0 then case when n_nationkey % 8 = 0 then 'bus' else 'subway' end else route_name end as key,
        case when n_nationkey % 3 = 0 then 'all' else cast(5 + n_nationkey % 18 as string) end as hour, cast(120 + n_nationkey * 17 as double) as headway_s, n_nationkey as seq
      from nation join (select distinct line_no, route_name from fx_line_stop) ls on ls.line_no = n_nationkey where n_nationkey not in (4, 12, 20)""",
    "transfers_table": """select p_partkey as seq, case when p_partkey % 10 = 0 then 'mode' else 'station' end as scope, case when p_partkey % 20 = 0 then 'bus' when p_partkey % 10 = 0 then 'subway'
        else concat(case when p_partkey % 2 = 0 then 'bus' else 'subway' end, ':S', lpad(cast(p_partkey % 60 as string), 2, '0')) end as key,
        case when p_partkey % 13 = 0 then null else cast(60 + p_partkey % 300 as double) end as transfer_time_s from part""",
}

# the same statements run on Spark as the small calibration tables
fixtures.MAPPING.update({k: BLOCKS[k] for k in ("speeds_table", "headways_table", "transfers_table")})


def latest(df, *keys):
    """The last row of each key, by seq, as a re-read table has it."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "seq").alias("x")).select(*keys, "x.*")


def speeds(spark, sf):
    return latest(fixtures.load(spark, sf, "speeds_table"), "scope", "key", "period")


def headways(spark, sf):
    return latest(fixtures.load(spark, sf, "headways_table"), "scope", "key", "hour")


BLOCKS |= {
    "speeds": "select scope, key, period, arg_max({'s': speed_kmh, 'd': dwell_s, 'y': stop_delay_s, 'h': terminal_hold_s}, seq) as x from speeds_table group by all",
    "headways": "select scope, key, hour, arg_max(headway_s, seq) as headway_s from headways_table group by all",
    "line_modes": "select distinct line, mode from line_stops",
    "line_speeds": """select line, mode, l.period, coalesce(nullif(a.x.s, 0), nullif(b.x.s, 0), nullif(c.x.s, 0), nullif(d.x.s, 0), case mode when 'subway' then 35.0 else 18.0 end) as speed_kmh,
        coalesce(a.x.d, b.x.d, c.x.d, d.x.d, case mode when 'subway' then 35.0 else 25.0 end) as dwell_s, coalesce(a.x.y, b.x.y, c.x.y, d.x.y, 0.0) as stop_delay_s, coalesce(a.x.h, b.x.h, c.x.h, d.x.h, 0.0) as terminal_hold_s
      from (select *, unnest(['all', 'am_peak', 'pm_peak', 'off_peak', 'night']) as period from line_modes) l
      left join speeds a on a.scope = 'line' and a.key = line and a.period = l.period left join speeds b on b.scope = 'line' and b.key = line and b.period = 'all'
      left join speeds c on c.scope = 'mode' and c.key = mode and c.period = l.period left join speeds d on d.scope = 'mode' and d.key = mode and d.period = 'all'""",
    "segments": "select s.line, s.mode, period, pos, node, seg, case when pos > 0 then seg / (speed_kmh / 3.6) + stop_delay_s end as time, dwell_s, terminal_hold_s from line_stops s join line_speeds v on v.line = s.line",
    "rides": "select * from (select line, mode, period, pos, lag(node) over (partition by line, period order by pos) as f, node as t, seg, time + case when pos > 1 then dwell_s else 0 end as time from segments) where pos > 0",
    "line_headways": """select l.line, l.mode, l.hour, greatest(coalesce(a.headway_s, b.headway_s, c.headway_s, d.headway_s, case l.mode
          when 'subway' then case when l.hour <= 9 then 180.0 when l.hour <= 14 then 360.0 when l.hour <= 19 then 180.0 else 480.0 end
          else case when l.hour <= 9 then 420.0 when l.hour <= 17 then 600.0 else 900.0 end end), 10.0) as headway_s
      from (select *, unnest(range(0, 24)) as hour from line_modes) l
      left join headways a on a.scope = 'line' and a.key = line and a.hour = cast(l.hour as varchar) left join headways b on b.scope = 'line' and b.key = line and b.hour = 'all'
      left join headways c on c.scope = 'mode' and c.key = mode and c.hour = cast(l.hour as varchar) left join headways d on d.scope = 'mode' and d.key = mode and d.hour = 'all'""",
    "shared_walk": f"""select a.key as f, b.key as t, 'shared_id' as kind, greatest({ora_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1.2, 180.0) as time
      from stations a join stations b on a.raw_id = b.raw_id and a.mode <> b.mode where not exists (from walk w where w.f = a.key and w.t = b.key)""",
}


@base.shared
def walks(spark, sf):
    return network.walk_edges(base.edges(spark, sf), base.known(spark, sf))


@base.shared
def line_speeds(spark, sf):
    lines = network.line_periods(base.stops(spark, sf))
    return network.speed_lookup(lines, speeds(spark, sf), params.MODE_SPEED_KMH, params.MODE_DWELL_S)


def segments(spark, sf):
    return network.segment_times(base.stops(spark, sf), line_speeds(spark, sf))


def rides(spark, sf):
    return network.vehicle_edges(segments(spark, sf))


@base.shared
def line_headways(spark, sf):
    lines = network.hours_of_lines(base.stops(spark, sf)).drop("period")
    return network.headway_lookup(lines, headways(spark, sf), params.HEADWAY_BY_HOUR)


@query("net_stations", "select * from stations")
def net_stations(spark, sf):
    return base.known(spark, sf)


@query("net_line_stops", "select line, mode, line_seq, cast(pos as int) as pos, node, seg, cum from line_stops")
def net_line_stops(spark, sf):
    return base.stops(spark, sf)


@query("net_loops", "select line, n, is_loop from loops")
def net_loops(spark, sf):
    return network.loops(base.stops(spark, sf)).select("line", "n", "is_loop")


@query("net_station_lines", "select node, list_sort(list(distinct line)) as lines from line_stops group by node")
def net_station_lines(spark, sf):
    return network.station_lines(base.stops(spark, sf))


@query("net_legs", "select line, o, d, cast(i as int) as i, cast(j as int) as j, cast(hops as int) as hops, dist, cast(hops - 1 as int) as n_int from legs")
def net_legs(spark, sf):
    return base.legs(spark, sf).select("line", "o", "d", "i", "j", "hops", "dist", "n_int")


@query("net_walk_edges", "select f, t, kind, round(time, 6) as time from walk")
def net_walk_edges(spark, sf):
    return walks(spark, sf).withColumn("time", F.round("time", 6))


@query("net_shared_id_edges", "select f, t, kind, round(time, 6) as time from shared_walk")
def net_shared_id_edges(spark, sf):
    return network.shared_id_edges(base.known(spark, sf), walks(spark, sf)).withColumn("time", F.round("time", 6))


@query("net_speed_lookup", "select * replace (cast(speed_kmh as double) as speed_kmh, cast(dwell_s as double) as dwell_s) from line_speeds")
def net_speed_lookup(spark, sf):
    return line_speeds(spark, sf)


@query("net_segment_times", "select line, period, cast(pos as int) as pos, node, round(time, 6) as time from segments")
def net_segment_times(spark, sf):
    return segments(spark, sf).select("line", "period", "pos", "node", F.round("time", 6).alias("time"))


@query("net_vehicle_edges", "select line, period, cast(pos as int) as pos, f, t, round(time, 6) as time from rides")
def net_vehicle_edges(spark, sf):
    return rides(spark, sf).select("line", "period", "pos", "f", "t", F.round("time", 6).alias("time"))


@query("net_headway_lookup", "select line, mode, cast(hour as int) as hour, headway_s from line_headways")
def net_headway_lookup(spark, sf):
    return line_headways(spark, sf)


@query("net_headway_avg", "select line, mode, round(avg(headway_s), 6) as headway_s from line_headways where hour between 5 and 23 group by all")
def net_headway_avg(spark, sf):
    lines = base.stops(spark, sf).select("line", "mode").distinct()
    return network.headway_average(lines, headways(spark, sf), params.HEADWAY_BY_HOUR).withColumn("headway_s", F.round("headway_s", 6))


@query("net_transfer_times", """select key, coalesce(x, transfer_time) as transfer_time from stations left join (select s.key, arg_max(transfer_time_s, seq) as x from stations s join transfers_table t
  on (t.scope = 'mode' and t.key = s.mode) or (t.scope = 'station' and t.key = s.key) where transfer_time_s is not null group by s.key) using (key)""")
def net_transfer_times(spark, sf):
    return network.apply_transfer_times(base.known(spark, sf), fixtures.load(spark, sf, "transfers_table")).select("key", "transfer_time")


fixtures.MAPPING["idents"] = BLOCKS["idents"] = """select distinct case when l_partkey % 3 = 0 then concat('bus:S', lpad(cast(l_suppkey % 70 as string), 2, '0')) else concat('S', lpad(cast(l_suppkey % 70 as string), 2, '0')) end as ident,
  case l_linenumber % 3 when 0 then 'bus' when 1 then 'subway' end as mode from lineitem"""


@query("net_resolve_node", """select ident, i.mode, coalesce(a.key, case when i.mode is not null then b.key else c.key end) as key from idents i left join stations a on a.key = ident
  left join stations b on b.key = concat(i.mode, ':', ident) left join (select raw_id, min(key) as key from stations group by raw_id having count(*) = 1) c on c.raw_id = ident""")
def net_resolve_node(spark, sf):
    return network.resolve_nodes(fixtures.load(spark, sf, "idents"), base.known(spark, sf))


@query("net_by_name", "select name, list_sort(list(key)) as keys from stations group by name")
def net_by_name(spark, sf):
    return network.stations_by_name(base.known(spark, sf))


@query("net_summary", """select (select count(*) from stations) as stations, (select count(*) from line_stops) as stops, (select count(*) from line_modes where mode = 'subway') as subway_lines,
  (select count(*) from line_modes where mode = 'bus') as bus_lines, (select count(*) from walk) as walk_edges, (select count(*) from rides where period = 'all') as vehicle_edges""")
def net_summary(spark, sf):
    return network.summary(base.known(spark, sf), base.stops(spark, sf), walks(spark, sf), rides(spark, sf).where("period = 'all'"))


# ---- matching

BLOCKS |= {
    "by_norm": f"select mode, {ora_station('name')} as norm, min(key) as key from stations group by all",
    "subway_match": f"""select o_name, d_name, o_key, d_key, b.line as route_name, coalesce(b.i, -1) as o_idx, coalesce(b.j, -1) as d_idx, b.dist as route_dist_m, coalesce(b.hops - 1, -1) as n_intermediate,
        case when o_key is null or d_key is null then 'no_station' when b.line is null then 'transfer' else 'same_line' end as match
      from (select o_name, d_name, a.key as o_key, b.key as d_key from (select distinct o_name, d_name from clean where mode = 'subway') p
        left join by_norm a on a.mode = 'subway' and a.norm = {ora_station('o_name')} left join by_norm b on b.mode = 'subway' and b.norm = {ora_station('d_name')}) p
      left join (select * from (select *, row_number() over (partition by o, d order by hops, line, i, j) as r from legs) where r = 1) b on b.o = o_key and b.d = d_key""",
    "bus_groups": "select line_raw, o_name, d_name, median(o_lon) as o_lon, median(o_lat) as o_lat, median(d_lon) as d_lon, median(d_lat) as d_lat from clean where mode = 'bus' group by all",
    "bus_lines": f"select distinct line, line_seq, {ora_variant('line')} as v, nullif({ora_core('line')}, '') as c from line_stops where mode = 'bus'",
    "bus_raw": f"select line_raw, {ora_variant('line_raw')} as v, nullif({ora_core('line_raw')}, '') as c from (select distinct line_raw from bus_groups)",
    "bus_how": """select line_raw, l.line, l.line_seq, 'variant' as how from bus_raw r join bus_lines l using (v)
      union all select line_raw, l.line, l.line_seq, 'core' from bus_raw r join bus_lines l using (c) where not exists (from bus_lines x where x.v = r.v)""",
    "bus_candidates": "select g.*, line, line_seq, coalesce(how, 'no_line') as how from bus_groups g left join bus_how using (line_raw)",
    "places": f"select line, pos, {ora_station('name')} as norm, lon, lat from first_stops join stations on key = node",
    "ends": """select line_raw, o_name, d_name, line, 'o' as side, o_name as name, o_lon as lon, o_lat as lat from bus_candidates where line is not null
      union all select line_raw, o_name, d_name, line, 'd', d_name, d_lon, d_lat from bus_candidates where line is not null""",
    "located": f"""select e.line_raw, e.o_name, e.d_name, e.line, e.side, coalesce(n.pos, c.pos, -1) as pos, case when n.pos is not null then 'name' when c.pos is not null then 'coord' else 'none' end as how from ends e
      left join (select line, norm, min(pos) as pos from places group by all) n on n.line = e.line and n.norm = {ora_station('e.name')}
      left join (select line_raw, o_name, d_name, line, side, arg_min(pos, (far, pos)) as pos from (select e.*, p.pos, {ora_haversine('e.lat', 'e.lon', 'p.lat', 'p.lon')} as far from ends e join places p on p.line = e.line) group by all having min(far) <= 200) c
        on c.line_raw = e.line_raw and c.o_name = e.o_name and c.d_name = e.d_name and c.line = e.line and c.side = e.side""",
    "bus_match": """select k.line_raw, k.o_name, k.d_name, b.o as o_key, b.d as d_key, b.line as route_name, coalesce(b.i, -1) as o_idx, coalesce(b.j, -1) as d_idx, b.dist as route_dist_m, coalesce(b.hops - 1, -1) as n_intermediate,
        coalesce(concat_ws('_', k.how, b.oh, b.dh), case k.how when 'no_line' then 'no_line' else concat(k.how, '_no_stop') end) as match0,
        case when b.line is null then case k.how when 'no_line' then 'no_line' else concat(k.how, '_no_stop') end else concat_ws('_', k.how, b.oh, b.dh) end as match
      from (select line_raw, o_name, d_name, min(how) as how from bus_candidates group by all) k
      left join (select * from (select c.line_raw, c.o_name, c.d_name, c.line, g.o, g.d, g.i, g.j, g.dist, g.hops, a.how as oh, b.how as dh,
          row_number() over (partition by c.line_raw, c.o_name, c.d_name order by case when a.how = 'name' and b.how = 'name' then 0 else 1 end, g.hops, c.line_seq) as r
        from bus_candidates c join located a on a.side = 'o' and a.line_raw = c.line_raw and a.o_name = c.o_name and a.d_name = c.d_name and a.line = c.line
        join located b on b.side = 'd' and b.line_raw = c.line_raw and b.o_name = c.o_name and b.d_name = c.d_name and b.line = c.line
        join legs g on g.line = c.line and g.i = a.pos and g.j = b.pos) where r = 1) b using (line_raw, o_name, d_name)""",
    "matched": """select c.*, coalesce(s.o_key, b.o_key) as o_key, coalesce(s.d_key, b.d_key) as d_key, coalesce(s.route_name, b.route_name) as route_name, cast(coalesce(s.o_idx, b.o_idx) as int) as o_idx, cast(coalesce(s.d_idx, b.d_idx) as int) as d_idx,
        coalesce(s.route_dist_m, b.route_dist_m) as route_dist_m, cast(coalesce(s.n_intermediate, b.n_intermediate) as int) as n_intermediate, coalesce(s.match, b.match) as match, coalesce(s.route_name, b.route_name) is not null as same_line
      from clean c left join subway_match s on c.mode = 'subway' and c.o_name = s.o_name and c.d_name = s.d_name left join bus_match b on c.mode = 'bus' and c.line_raw = b.line_raw and c.o_name = b.o_name and c.d_name = b.d_name""",
}
_MATCH = "o_key, d_key, route_name, cast(o_idx as int) as o_idx, cast(d_idx as int) as d_idx, route_dist_m, cast(n_intermediate as int) as n_intermediate, match"


@query("match_subway_pairs", f"select o_name, d_name, {_MATCH} from subway_match")
def match_subway_pairs(spark, sf):
    return base.subway_pairs(spark, sf)


@query("match_bus_groups", "select * from bus_groups")
def match_bus_groups(spark, sf):
    return base.bus_groups(spark, sf)


@query("match_bus_candidates", "select line_raw, o_name, d_name, line, line_seq, how from bus_candidates")
def match_bus_candidates(spark, sf):
    return base.bus_candidates(spark, sf).select("line_raw", "o_name", "d_name", "line", "line_seq", "how")


@query("match_locate_stop", """select a.line_raw, a.o_name, a.d_name, a.line, cast(a.pos as int) as o_pos, a.how as o_how, cast(b.pos as int) as d_pos, b.how as d_how from located a join located b
  using (line_raw, o_name, d_name, line) where a.side = 'o' and b.side = 'd'""")
def match_locate_stop(spark, sf):
    return matching.locate_stops(base.bus_candidates(spark, sf), base.known(spark, sf), base.stops(spark, sf)).select("line_raw", "o_name", "d_name", "line", "o_pos", "o_how", "d_pos", "d_how")


@query("match_bus_pairs", f"select line_raw, o_name, d_name, {_MATCH} from bus_match")
def match_bus_pairs(spark, sf):
    return base.bus_pairs(spark, sf)


@query("match_join_back", f"select {KEYS}, mode, o_key, d_key, route_name, o_idx, d_idx, route_dist_m, n_intermediate, match, same_line from matched")
def match_join_back(spark, sf):
    return base.matched(spark, sf).select(*ROW, "mode", *matching.OUT, "same_line")


@query("match_report", """select mode, match, count(*) as n, cast(sum(cast(o_key is not null and d_key is not null as int)) as bigint) as both_ends, cast(sum(cast(same_line as int)) as bigint) as same_line from matched group by mode, match""")
def match_report(spark, sf):
    return matching.match_report(base.matched(spark, sf))
