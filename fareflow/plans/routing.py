"""Queries of transfers, routes, timetables, streams, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.functions.columns import period
from fareflow.operators import demand as demand_operators
from fareflow.operators import network, routes, timetable, transfer
from fareflow.plans import base, demand, taps
from fareflow.plans.registry import BLOCKS, KEYS, ora_period, query
from fareflow.plans.times import rounded
from fareflow.sources import fixtures, tables
from fareflow.streaming import streams


_TRANSFERRING = "mode = 'subway' and not same_line and o_key is not null and d_key is not null and tt_adj_s > 120 and tt_adj_s < 7200"
#: Rounds of the SQL, more than any route there has legs; routes of a label list.
ROUNDS, LISTED = 13, 5
_UP = "case when l.line is not null then l.line when s.tag = '' then '' else '*' end"
_WEIGHT = """s.weight + (l.ms + case when l.line is null or s.tag = l.line or s.tag = '' then 0 when s.tag = '*' then 180000 else 180000 + cast(round(x.transfer_time * 1000) as bigint) end) * 1000000
  + 1 + case when l.line is null then 100 when s.tag = l.line then 0 else 10000 end"""
_COST = "floor({0} / 1000000) / 1000"
BLOCKS |= {
    "timed_stops": """select line, pos, node, cast(round(cum * 1000) as bigint) as since from (select s.line, s.pos, s.node, sum(coalesce(r.time, 0)) over (partition by s.line order by s.pos) as cum
      from line_stops s left join (select line, pos, time from rides where period = 'all') r on r.line = s.line and r.pos = s.pos)""",
    "timed_lines": "select line, max(since) as total, list(node order by pos) as nodes, count(*) as n from timed_stops group by line",
    "tlegs": """select line, f, t, i, j, ms, lo, hi, total, nodes from (select a.line, a.node as f, b.node as t, a.pos as i, b.pos as j, a.since as lo, b.since as hi, w.total,
        case when b.pos > a.pos then b.since - a.since else w.total - a.since + b.since end as ms, case when b.pos > a.pos then w.nodes[a.pos + 2 : b.pos + 1] else list_concat(w.nodes[a.pos + 2 : w.n], w.nodes[2 : b.pos + 1]) end as nodes
      from timed_stops a join timed_stops b on a.line = b.line and a.node <> b.node join timed_lines w on w.line = a.line where b.pos > a.pos or (w.n > 2 and w.nodes[1] = w.nodes[w.n] and b.pos < a.pos))
      qualify row_number() over (partition by line, f, t order by ms, i, j) = 1""",
    "top_od": f"select o_key, d_key, count(*) as trips from matched where {_TRANSFERRING} group by all order by trips desc, o_key, d_key limit 4000",
    "walk_all": "select f, t, time from walk union all select f, t, time from shared_walk",
    "rlegs": """select line, f, t, i, j, ms, lo, hi, total, nodes from tlegs union all
      select cast(null as varchar), f, t, cast(null as bigint), cast(null as bigint), cast(round(min(time) * 1000) as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), [t] from walk_all where f <> t group by f, t""",
    "state0": "select key as origin, key as node, '' as tag, cast(0 as bigint) as weight from stations",
    "best_end": f"select o_key, d_key, weight, tag from top_od join state{ROUNDS} on origin = o_key and node = d_key qualify row_number() over (partition by o_key, d_key order by weight, tag) = 1",
    "single_od": """select o_key, d_key, a.line as line1, b.line as line2, a.t as station, (a.ms + b.ms) / 1000 as ivt from best_end join rlegs a on a.f = o_key join rlegs b on b.f = a.t and b.t = d_key and b.line = tag and a.line <> b.line
      join stations s on s.key = a.t where (a.ms + b.ms + 180000 + cast(round(s.transfer_time * 1000) as bigint)) * 1000000 + 20002 = weight qualify row_number() over (partition by o_key, d_key order by a.t, a.line) = 1""",
    "resid": f"""select m.*, s.station, {ora_period('((dep_s % 86400) / 3600.0)')} as period, tt_adj_s - (120 + 70 + ivt + 0.5 * coalesce(a.headway_s, 300) + 0.5 * coalesce(b.headway_s, 300)) as resid
      from (select * from matched where {_TRANSFERRING}) m join single_od s on s.o_key = m.o_key and s.d_key = m.d_key
      left join line_headways a on a.line = s.line1 and a.hour = cast(floor(dep_s / 3600) as int) % 24 left join line_headways b on b.line = s.line2 and b.hour = cast(floor(dep_s / 3600) as int) % 24""",
    "valid_resid": "select * from resid where resid > -900 and resid < 2400",
    "asked_od": "select distinct concat(origin_type, ':', origin_id) as o_key, concat(destination_type, ':', destination_id) as d_key from demand where concat(origin_type, ':', origin_id) <> concat(destination_type, ':', destination_id)",
    "label0": "select distinct o_key as origin, o_key as node, '' as tag, cast(0 as bigint) as weight, '' as name, '' as lines, cast([] as struct(line varchar, lo bigint, hi bigint)[]) as spans, [o_key] as seen, 0 as r from asked_od",
    "pool": f"""select o_key, d_key, weight, name, lines, spans, coalesce(list_sum(list_transform(spans, lambda x: x.hi - x.lo)), 0) as ride, row_number() over (partition by o_key, d_key order by weight, name) as idx
      from asked_od join label{ROUNDS} on origin = o_key and node = d_key""",
    "pool_spans": "select o_key, d_key, idx, ride, unnest(spans) as x from pool",
    "too_near": """select a.o_key, a.d_key, a.idx as a, b.idx as b from pool_spans a join pool_spans b on a.o_key = b.o_key and a.d_key = b.d_key and a.idx < b.idx and a.x.line = b.x.line
      group by all having sum(greatest(least(a.x.hi, b.x.hi) - greatest(a.x.lo, b.x.lo), 0)) * 100 > least(any_value(a.ride), any_value(b.ride)) * 80""",
    "taken1": "select o_key, d_key, idx, 1 as rnk from pool where idx = 1",
}
for _k in range(1, ROUNDS + 1):
    BLOCKS[f"state{_k}"] = f"""select origin, node, tag, min(weight) as weight from (select * from state{_k - 1} union all
      select s.origin, l.t, {_UP}, {_WEIGHT} from state{_k - 1} s join stations x on x.key = s.node join rlegs l on l.f = s.node) group by all"""
    BLOCKS[f"label{_k}"] = f"""select * from (select * from (select * from label{_k - 1} union all select s.origin, l.t as node, {_UP} as tag, {_WEIGHT} as weight,
        case when s.name = '' then '' else s.name || ';' end || coalesce(l.line, '') || '>' || l.t as name, case when l.line is null then s.lines when s.lines = '' then l.line else s.lines || chr(10) || l.line end as lines,
        case when l.line is null then s.spans when l.j > l.i then list_append(s.spans, {{'line': l.line, 'lo': l.lo, 'hi': l.hi}}) else list_concat(s.spans, [{{'line': l.line, 'lo': l.lo, 'hi': l.total}}, {{'line': l.line, 'lo': cast(0 as bigint), 'hi': l.hi}}]) end as spans,
        list_concat(s.seen, l.nodes) as seen, {_k} as r
      from label{_k - 1} s join stations x on x.key = s.node join rlegs l on l.f = s.node where s.r = {_k - 1} and not list_has_any(s.seen, l.nodes) and len(list_distinct(l.nodes)) = len(l.nodes) and coalesce(l.line <> s.tag, true))
      qualify row_number() over (partition by origin, node, tag, lines order by weight, name) = 1) qualify row_number() over (partition by origin, node, tag order by weight, name) <= {LISTED}"""
for _k in range(2, 6):
    BLOCKS[f"taken{_k}"] = f"""select * from taken{_k - 1} union all select p.o_key, p.d_key, min(p.idx), {_k} from pool p join (select o_key, d_key, max(idx) as last from taken{_k - 1} group by all) t on t.o_key = p.o_key and t.d_key = p.d_key and p.idx > last
      where (p.o_key, p.d_key, p.idx) not in (select n.o_key, n.d_key, n.b from too_near n join taken{_k - 1} q on q.o_key = n.o_key and q.d_key = n.d_key and q.idx = n.a) group by p.o_key, p.d_key"""


@base.shared
def ways(spark, sf):
    """Rides and walks of the network."""
    known, first = base.known(spark, sf), taps.walks(spark, sf).select("f", "t", "time")
    walks = first.unionByName(network.shared_id_edges(known, taps.walks(spark, sf)).select("f", "t", "time"))
    return routes.route_legs(base.stops(spark, sf), taps.rides(spark, sf).where("period = 'all'"), walks)


@base.shared
def route_pool(spark, sf):
    """Candidates for all pairs of the demand."""
    od = demand.od(spark, sf).select(F.col("origin").alias("o_key"), F.col("destination").alias("d_key"))
    return routes.candidates(od, ways(spark, sf), base.known(spark, sf), base.cut, keep=LISTED)


@base.shared
def single_od(spark, sf):
    od = transfer.top_od(base.matched(spark, sf)).select("o_key", "d_key")
    return transfer.single_transfer_od(routes.shortest(od, ways(spark, sf), base.known(spark, sf), base.cut))


@base.shared
def resid(spark, sf):
    per_stop = spark.createDataFrame([("all", 35.0)], "period string, c double")
    return transfer.residuals(base.matched(spark, sf), single_od(spark, sf), 120.0, per_stop, taps.line_headways(spark, sf).select("line", "hour", "headway_s"))


@query("transfer_top_od", "select o_key, d_key, trips, round(trips / (select sum(trips) from (select count(*) as trips from matched where " + _TRANSFERRING + " group by o_key, d_key)), 9) as share from top_od")
def transfer_top_od(spark, sf):
    return rounded(transfer.top_od(base.matched(spark, sf)), digits=9)


@query("transfer_single_od", "select o_key, d_key, line1, line2, station, round(ivt, 6) as ivt from single_od")
def transfer_single_od(spark, sf):
    return rounded(single_od(spark, sf))


@query("transfer_residuals", f"select {KEYS}, station, period, round(resid, 6) as resid from valid_resid")
def transfer_residuals(spark, sf):
    return rounded(resid(spark, sf).select(*base.ROW, "station", "period", "resid"), "l_extendedprice")


_T = "least(greatest(median(resid), 60.0), 600.0)"


@query("transfer_table", f"""select 'mode' as scope, 'subway' as key, round(cast({_T} as double), 6) as transfer_time_s, count(*) as n_obs, round(median(resid), 6) as raw_median_s, round(quantile_cont(resid, 0.25), 6) as q25, round(quantile_cont(resid, 0.75), 6) as q75 from valid_resid having count(*) > 0
  union all select 'station', station, round(cast({_T} as double), 6), count(*), round(median(resid), 6), round(quantile_cont(resid, 0.25), 6), round(quantile_cont(resid, 0.75), 6) from valid_resid group by station having count(*) >= 10""")
def transfer_table(spark, sf):
    return rounded(transfer.transfer_table(resid(spark, sf), min_obs=10))


@query("transfer_profile", """select concat('median_', period) as name, round(median(resid), 6) as value from valid_resid group by period
  union all select unnest(['q_0.1', 'q_0.25', 'q_0.5', 'q_0.75', 'q_0.9']), unnest(list_transform(quantile_cont(resid, [0.1, 0.25, 0.5, 0.75, 0.9]), lambda x: round(x, 6))) from valid_resid""")
def transfer_profile(spark, sf):
    return rounded(transfer.profile(resid(spark, sf)))


# ---- routes


@query("route_shortest", f"select origin, node, {_COST.format('w')} as cost, cast(w % 1000000 // 10000 as int) as boardings, cast(w % 10000 // 100 as int) as walks from (select origin, node, min(weight) as w from state{ROUNDS} where origin like 'subway:%' group by all)")
def route_shortest(spark, sf):
    known = base.known(spark, sf)
    states = routes.search(known.where("mode = 'subway'"), ways(spark, sf), known, base.cut)
    return states.groupBy("origin", "node").agg(F.min("weight").alias("w")).select("origin", "node", *[c.alias(name) for name, c in routes.parts_of(F.col("w")).items()])


@query("route_candidates", f"select p.o_key, p.d_key, cast(t.rnk as int) as rnk, p.name, replace(p.lines, chr(10), ',') as lines, {_COST.format('p.weight')} as cost, cast(p.weight % 1000000 // 10000 as int) as boardings, cast(p.weight % 10000 // 100 as int) as walks from taken5 t join pool p on p.o_key = t.o_key and p.d_key = t.d_key and p.idx = t.idx")
def route_candidates(spark, sf):
    found = route_pool(spark, sf)
    parts = [c.alias(name) for name, c in routes.parts_of(F.col("weight")).items()]
    return found.select("o_key", "d_key", "rnk", routes.named(F.col("path")).alias("name"), F.array_join(routes.lines_of(F.col("path")), ",").alias("lines"), *parts)


_EDGES = """select l_orderkey as od, cast(l_linenumber as int) as seq, case when min(l_partkey) % 5 = 0 then null else concat('L', cast(min(l_suppkey) % 3 as string)) end as line,
  concat(case when l_linenumber % 2 = 0 then 'bus' else 'subway' end, ':N', cast(l_linenumber as string)) as f, concat(case when l_linenumber % 2 = 1 then 'bus' else 'subway' end, ':N', cast(l_linenumber + 1 as string)) as t,
  case when min(l_partkey) % 5 = 0 then 'walk' when min(l_suppkey) % 3 = 0 then 'subway' else 'bus' end as mode, cast(min(l_quantity) * 75 as double) as distance, cast(min(l_quantity) * 10 as double) as time from lineitem group by l_orderkey, l_linenumber"""
fixtures.MAPPING["route_edges"] = BLOCKS["route_edges"] = _EDGES
BLOCKS |= {
    "edges_a": "select * from route_edges where line is not null",
    "edges_b": "select od, seq, line, f, t, time from route_edges where line is not null and seq % 2 = 1",
    "marked_edges": """select *, last_value(line ignore nulls) over (partition by od order by seq rows between unbounded preceding and 1 preceding) as before, lag(line is null) over (partition by od order by seq) as on_foot from route_edges""",
    "boarded_edges": "select *, line is not null and (before is null or line <> before or coalesce(on_foot, false)) as boards, case line when 'L0' then 300.0 when 'L1' then 480.0 when 'L2' then 600.0 end as headway_s from marked_edges",
}


def route_edges(spark, sf):
    return fixtures.load(spark, sf, "route_edges")


@query("route_overlap", """select coalesce(a.od, b.od) as od, round(case when least(coalesce(ta, 0), coalesce(tb, 0)) > 0 then coalesce(s, 0) / least(ta, tb) else 0 end, 6) as overlap from (select od, sum(time) as ta from edges_a group by od) a
  full join (select od, sum(time) as tb from edges_b group by od) b on a.od = b.od left join (select od, sum(time) as s from edges_a x where exists (from edges_b y where y.od = x.od and y.f = x.f and y.t = x.t and y.line = x.line) group by od) c on c.od = coalesce(a.od, b.od)""")
def route_overlap(spark, sf):
    a = route_edges(spark, sf).where("line is not null")
    return rounded(routes.overlap(a, a.where("seq % 2 = 1")))


@query("route_perceived_cost", """select od, round(sum(time + case when line is not null and before is not null and (line <> before or on_foot) then 180 + case when on_foot then 0 else 60 + 10 * length(f) + cast(f like 'bus%' as int) * 25 end else 0 end), 6) as cost
  from marked_edges group by od""")
def route_perceived_cost(spark, sf):
    edges = route_edges(spark, sf)
    at = F.col("key")
    times = edges.select(F.col("f").alias("key")).distinct().withColumn("transfer_time", 60.0 + 10 * F.length(at) + F.when(at.like("bus%"), 25.0).otherwise(0.0))
    return rounded(routes.perceived_cost(edges, times))


@query("route_attributes", """select od, sum(case when line is not null then time else 0 end) as in_vehicle_time, sum(case when line is null then time else 0 end) as walk_time, cast(sum(cast(boards as int)) as bigint) as boardings,
  greatest(cast(sum(cast(boards as int)) as bigint) - 1, 0) as num_transfers, cast(sum(case when boards then headway_s / 2 else 0 end) as double) as expected_wait,
  cast(case when arg_min(f, seq) like 'bus:%' then 40 else 90 end + case when arg_max(t, seq) like 'bus:%' then 40 else 90 end as double) as access_egress_time,
  cast(sum(time) + sum(case when boards then headway_s / 2 else 0 end) + case when arg_min(f, seq) like 'bus:%' then 40 else 90 end + case when arg_max(t, seq) like 'bus:%' then 40 else 90 end as double) as total,
  round(sum(distance) / 1000, 6) as total_distance, case when bool_or(mode = 'bus') and bool_or(mode = 'subway') then 7 when bool_or(mode = 'subway') then 2 when bool_or(mode = 'bus') then 1 else 0 end as mode_type,
  array_to_string(list(line order by seq) filter (boards), ',') as lines, array_to_string(list(f order by seq) filter (boards), ',') as boarding_nodes from boarded_edges group by od""")
def route_attributes(spark, sf):
    headways = spark.createDataFrame([("L0", 300.0), ("L1", 480.0), ("L2", 600.0)], "line string, headway_s double")
    out = routes.attributes(route_edges(spark, sf), headways, {"bus": 40.0, "subway": 90.0}).withColumn("total_distance", F.round("total_distance", 6))
    return out.withColumns({c: F.when(F.col("boardings") > 0, F.array_join(c, ",")) for c in ("lines", "boarding_nodes")})


@query("route_cache_merge", """select o_key, d_key, rnk, lines, (select count(*) from asked_od) as pairs, (select count(*) from asked_od where (o_key, d_key) not in (select o_key, d_key from pool)) as without_route from (
  select o_key, d_key, cast(t.rnk as int) as rnk, replace(lines, chr(10), ',') as lines from taken5 t join pool p using (o_key, d_key, idx)
  union all select o_key, d_key, cast(null as int), cast(null as varchar) from asked_od where (o_key, d_key) not in (select o_key, d_key from pool))""")
def route_cache_merge(spark, sf):
    """The pairs of one half of the origins are stored first, then all pairs are asked for."""
    every = route_pool(spark, sf).select("o_key", "d_key", "rnk", F.array_join(routes.lines_of(F.col("path")), ",").alias("lines"))
    od = demand.od(spark, sf).select(F.col("origin").alias("o_key"), F.col("destination").alias("d_key"))
    path, half = base.folder(spark), F.crc32("o_key") % 2 == 0
    routes.update_cache(path, every.where(half), od.where(half))
    merged = routes.update_cache(path, every, od)
    return merged.drop("slice").crossJoin(F.broadcast(routes.cache_counts(merged)))  # one row


# ---- timetable

BLOCKS |= {
    "given_departures": """select line, cast(k as int) as k, cast(18000 + k * 900 as double) as t, """ + ora_period("((18000 + k * 900) / 3600.0)") + """ as period from line_modes, range(0, 60) r(k)""",
    "line_offsets": """select line, period, pos, node, sum(coalesce(time, 0) + case when pos > 1 then dwell_s else 0 end) over (partition by line, period order by pos) + case when pos > 0 then terminal_hold_s else 0 end as off from segments""",
    "stop_times": "select d.line, k, pos, node, t + off as arrive from given_departures d join line_offsets o on o.line = d.line and o.period = d.period",
}


@query("timetable_departures", """select * from (with recursive dep as (select line, 0 as k, cast(18000 as double) as t from line_modes union all
  select d.line, k + 1, ceil((t + headway_s) / 10) * 10 from dep d join line_headways h on h.line = d.line and h.hour = cast(floor(t / 3600) as int) % 24 where ceil((t + headway_s) / 10) * 10 < 84600)
  select line, cast(k as int) as k, cast(t as double) as t from dep)""")
def timetable_departures(spark, sf):
    return timetable.departures(base.stops(spark, sf).select("line"), taps.line_headways(spark, sf))


@base.shared
def stop_times(spark, sf):
    lines = base.stops(spark, sf).select("line").distinct()
    given = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("t", (18000 + F.col("k") * 900).cast("double"))
    return timetable.stop_times(given.withColumn("period", period(F.col("t"))), taps.segments(spark, sf))


@query("timetable_stop_times", "select line, k, cast(pos as int) as pos, node, round(cast(arrive as double), 6) as arrive from stop_times")
def timetable_stop_times(spark, sf):
    return rounded(stop_times(spark, sf))


@query("timetable_next_vehicle", """select r.id, r.node, r.line, r.ready, round(cast(min(arrive) as double), 6) as vehicle, round(cast(min(arrive) as double) - r.ready, 6) as wait, coalesce(min(arrive) - r.ready > 1500, true) as timed_out
  from (select distinct l_orderkey * 10 + l_linenumber as id, o_key as node, route_name as line, dep_s as ready from matched where route_name is not null) r left join stop_times s on s.node = r.node and s.line = r.line and s.arrive >= r.ready group by r.id, r.node, r.line, r.ready""")
def timetable_next_vehicle(spark, sf):
    rides = base.matched(spark, sf).where("route_name is not null")
    ready = rides.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_key").alias("node"), F.col("route_name").alias("line"), F.col("dep_s").alias("ready")).distinct()
    return rounded(timetable.next_vehicle(ready, stop_times(spark, sf).select("line", "node", "arrive")))


# ---- streams, readers and writers


def thirds(rows):
    """1 to 3 by the thirds of the time that rows span."""
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    low, third = low or 0, ((high or 0) - (low or 0)) / 3
    return F.when(us < low + third, 1).when(us < low + 2 * third, 2).otherwise(3)


def streamed(rows, part, make):
    """What a stream gives of rows that arrive in three batches, by part, with a restart from the checkpoint after each."""
    spark, folder, out = rows.sparkSession, base.folder(rows.sparkSession), base.folder(rows.sparkSession)
    for k in (1, 2, 3):
        rows.where(part == k).write.mode("append").parquet(folder)  # a stream reads a folder
        streams.run_available(make(spark.readStream.schema(rows.schema).parquet(folder)), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query("stream_demand_buckets", """select * from (with e as (select ts, event_type as mode, event_id % 41 = 0 as late, time_bucket(interval '10 seconds', ts) as start from events),
  bounds as (select min(ts) as a, max(ts) as b from events), p as (select e.*, case when ts < a + (b - a) / 3 then 1 when ts < a + (b - a) / 3 * 2 then 2 else 3 end as part from e, bounds),
  marks as (select max(ts) filter (part < 3 and not (late and part = 1)) - interval '1 hour' as second, max(ts) - interval '1 hour' as last from p)
  select start, mode, count(*) as trips from p, marks where not (late and part = 1 and start + interval '10 seconds' <= second) and start + interval '10 seconds' <= last group by start, mode)""")
def stream_demand_buckets(spark, sf):
    """Some events of the first third come with the last batch, too late."""
    events = fixtures.given(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"), "event_id")
    own = thirds(events)
    late = (own == 1) & (F.col("event_id") % 41 == 0)
    return streamed(events, F.when(late, 3).otherwise(own), streams.stream_buckets).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_tap_clusters", """select * from (with source as (select route_name, o_key, make_timestamp(cast((dep_s + 1557705600) * 1000000 as bigint)) as ts from matched where mode = 'bus' and route_name is not null),
  marked as (select *, coalesce(ts - lag(ts) over (partition by route_name, o_key order by ts) > interval 90 second, true) as first from source),
  numbered as (select *, sum(cast(first as int)) over (partition by route_name, o_key order by ts rows unbounded preceding) as c from marked)
  select route_name, o_key, min(ts) as first, max(ts) as last, count(*) as taps from numbered group by route_name, o_key, c
  having max(ts) + interval 90 second <= (select max(ts) from source) - interval 1 hour)""")
def stream_tap_clusters(spark, sf):
    matched = base.matched(spark, sf).where("mode = 'bus' and route_name is not null")
    source = base.cut(matched.select("route_name", "o_key", F.timestamp_seconds(F.col("dep_s") + 1557705600).alias("ts")))
    out = streamed(source, thirds(source), streams.stream_clusters)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("read_taps", """select card, o_mode, o_line, cast(o_dir as smallint) as o_dir, cast(o_stopno as smallint) as o_stopno, o_name, o_lon, o_lat, dep, d_mode, d_line, cast(null as smallint) as d_dir, cast(d_stopno as smallint) as d_stopno, d_name, d_lon, d_lat, arr
  from fx_taps where dep <> 'bad'""")
def read_taps(spark, sf):
    path, raw = base.folder(spark), base.raw(spark, sf).where("dep <> 'bad'")
    none = F.lit(None).cast("string")
    ordered = [F.col(c) if c in raw.columns else none.alias(c) for c in (x.split()[0] for x in tables.RAW_TAPS.split(", "))]
    tables.write_table(raw.select(*ordered), path, fmt="csv")
    return tables.read_taps(spark, path)


@query("read_matched", f"select {KEYS}, mode, match from matched")
def read_matched(spark, sf):
    path = base.folder(spark)
    tables.write_table(base.matched(spark, sf), path, ["mode"])
    return tables.read_matched(spark, path, [*base.ROW, "mode", "match"])


@query("write_tables", "select mode, count(*) as n from matched group by mode")
def write_tables(spark, sf):
    path = base.folder(spark)
    tables.write_table(base.matched(spark, sf), path, ["mode"])
    return spark.read.parquet(path).groupBy("mode").agg(F.count("*").alias("n"))


@query("write_reports", "select count(*) as output_rows, count(*) filter (origin_type = 'bus') as bus from demand")
def write_reports(spark, sf):
    path = base.folder(spark)
    tables.write_report(demand_operators.convert_report(base.matched(spark, sf), demand.trips(spark, sf)), path)
    return spark.read.json(path).select("output_rows", "bus")


@query("read_demand", "select pid, cast(time as double) as time, origin_id from demand")
def read_demand(spark, sf):
    path = base.folder(spark)
    tables.write_table(demand.trips(spark, sf).withColumnRenamed("time", "departs"), path, fmt="csv")
    return tables.read_demand(spark, path, "departs").select("pid", "time", "origin_id")


@query("read_network", """select n.node_type, count(*) as stops, cast(sum(cast(n.node_id = e.first_from as int)) as bigint) as first, max(e.metres) as metres
  from fx_nodes n cross join (select arg_min(from_id, seq) as first_from, round(sum(distance), 6) as metres from fx_edges) e group by n.node_type""")
def read_network(spark, sf):
    nodes, edges = base.folder(spark), base.folder(spark)
    tables.write_table(fixtures.load(spark, sf, "fx_nodes"), nodes, fmt="csv")
    # the order of edges is that of the files' names and rows: seq itself isn't written
    tables.write_table(base.edges(spark, sf).repartitionByRange(3, "seq").sortWithinPartitions("seq").drop("seq"), edges, fmt="csv")
    n, e = tables.read_network(spark, nodes, edges)
    one = e.agg(F.min_by("from_id", "seq").alias("first_from"), F.sum("distance").alias("metres"))
    joined = n.crossJoin(F.broadcast(one))  # one row
    return rounded(joined.groupBy("node_type").agg(F.count("*").alias("stops"), F.sum((F.col("node_id") == F.col("first_from")).cast("int")).alias("first"), F.max("metres").alias("metres")))


@query("read_calibration_tables", "select scope, key, hour, headway_s from headways")
def read_calibration_tables(spark, sf):
    path = base.folder(spark)
    rows = fixtures.load(spark, sf, "headways_table").repartitionByRange(3, "seq").sortWithinPartitions("seq")
    tables.write_table(rows.select("scope", "key", "hour", "headway_s", F.lit(1).alias("n_obs"), F.lit("given").alias("method")), path, fmt="csv")
    return tables.read_headways(spark, path).select("scope", "key", "hour", "headway_s")
