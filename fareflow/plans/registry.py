"""Registration of queries with the SQL they are compared with, and the SQL's shared statements."""

from __future__ import annotations

import re

from fareflow.params import BBOX, BRACKETS, SHORTENED, VARIANTS
from fareflow.sources.fixtures import MAPPING, with_clause

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Statements on the comparing engine, by name.
BLOCKS: dict[str, str] = dict(MAPPING)


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql may use the tables and statements by name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            used = [b for b in BLOCKS if re.search(rf"\b{b}\b", sql)]
            ORACLES[name] = f"{with_clause(used, BLOCKS, 'materialized ')} {sql.strip()}" if used else sql.strip()
        return f

    return add


def ora_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def ora_given(c: str) -> str:
    return f"case when lower({ora_strip(c)}) not in ('', 'nan') then {ora_strip(c)} end"


def ora_station(c: str) -> str:
    s = f"replace({ora_given(c)}, ' ', '')"
    cut = f"case when {s} like '%站' and length({s}) > 2 then replace({s}, '站', '') else {s} end"
    return f"(case {cut} when '灵镜胡同' then '灵境胡同' when 'T2航站楼' then '2号航站楼' when 'T3航站楼' then '3号航站楼' else {cut} end)"


def ora_variant(c: str) -> str:
    s = f"regexp_replace({ora_given(c)}, '{BRACKETS}', '', 'g')"
    for long, short in SHORTENED.items():
        s = f"replace({s}, '{long}', '{short}')"
    return rf"nullif(regexp_replace({s}, '([0-9])线$', '\1'), '')"


def ora_core(c: str) -> str:
    return f"regexp_replace({ora_variant(c)}, '{VARIANTS}', '')"


def ora_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def ora_period(h: str) -> str:
    return f"(case when {h} >= 7 and {h} < 9 then 'am_peak' when {h} >= 17 and {h} < 19 then 'pm_peak' when {h} >= 22 or {h} < 5 then 'night' else 'off_peak' end)"


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LOW_LAT, LOW_LON, HIGH_LAT, HIGH_LON = BBOX
BOX = f"o_lat between {LOW_LAT} and {HIGH_LAT} and d_lat between {LOW_LAT} and {HIGH_LAT} and o_lon between {LOW_LON} and {HIGH_LON} and d_lon between {LOW_LON} and {HIGH_LON}"
THERE = "o_lat is not null and o_lon is not null and d_lat is not null and d_lon is not null and dep is not null and arr is not null"
VALID = "o_mode in ('公交', '地铁') and o_mode = d_mode and tt_s > 0 and tt_s <= 10800 and not (o_mode = '公交' and coalesce(o_name = d_name, false))"

BLOCKS |= {
    "timed": f"""select *, arr_s - dep_s as tt_s from (select *, epoch(a) - epoch(date_trunc('day', d)) as arr_s, epoch(d) - epoch(date_trunc('day', d)) as dep_s
      from (select *, try_strptime(dep, '%Y-%m-%d %H:%M:%S') as d, try_strptime(arr, '%Y-%m-%d %H:%M:%S') as a from fx_taps where {THERE} and {BOX}) where d is not null and a is not null)""",
    "clean": f"""select substr(card, 1, 12) as card, case o_mode when '公交' then 'bus' else 'subway' end as mode, o_line as line_raw, o_line, d_line, cast(o_dir as smallint) as o_dir, cast(o_stopno as smallint) as o_stopno, cast(d_stopno as smallint) as d_stopno, o_name, d_name, o_lon, o_lat, d_lon, d_lat, dep_s, arr_s, tt_s,
      case when o_mode = '地铁' then tt_s - 30 else tt_s end as tt_adj_s, {KEYS} from timed where {VALID}""",
    "stations": "select distinct concat(node_type, ':', node_id) as key, node_id as raw_id, node_type as mode, station_name as name, x as lon, y as lat, cast(case node_type when 'subway' then 240 else 60 end as double) as transfer_time from fx_nodes",
    "ride_edges": """select e.*, edge_type as mode, concat(edge_type, ':', from_id) as f, concat(edge_type, ':', to_id) as t from fx_edges e
      where edge_type in ('subway', 'bus') and concat(edge_type, ':', from_id) in (select key from stations) and concat(edge_type, ':', to_id) in (select key from stations)""",
    "line_stops": """select line, mode, line_seq, row_number() over (partition by line order by seq, k) - 1 as pos, node, seg, sum(seg) over (partition by line order by seq, k) as cum, count(*) over (partition by line) as n
      from (select route_name as line, mode, min(seq) over (partition by route_name) as line_seq, seq, unnest(case when p is null or p <> f then [0, 1] else [1] end) as k,
          unnest(case when p is null or p <> f then [f, t] else [t] end) as node, unnest(case when p is null or p <> f then [0.0, distance] else [distance] end) as seg
        from (select *, lag(t) over (partition by route_name order by seq) as p from ride_edges))""",
    "loops": "select line, n, arg_min(node, pos) = arg_max(node, pos) and n > 2 as is_loop from line_stops group by line, n",
    "first_stops": "select line, mode, line_seq, node, min(pos) as pos, min(cum) as cum from line_stops group by all",
    "legs": """select a.line, a.mode, a.line_seq, a.node as o, b.node as d, a.pos as i, b.pos as j, case when b.pos > a.pos then b.pos - a.pos else l.n - 1 - a.pos + b.pos end as hops,
      case when b.pos > a.pos then b.cum - a.cum else t.total - a.cum + b.cum end as dist
      from first_stops a join first_stops b on a.line = b.line and a.node <> b.node join loops l on l.line = a.line join (select line, max(cum) as total from line_stops group by line) t on t.line = a.line
      where b.pos > a.pos or (l.is_loop and b.pos < a.pos)""",
}
