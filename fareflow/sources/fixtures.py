"""The given tables as transit tables. The SQL text is the same on Spark and on the comparing engine."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGE = ("orders", "lineitem", "events")
#: Rows that a task gets at least where a large table is dealt out to more tasks than there are cores.
TASK_ROWS = 1_000_000
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

MAPPING = {
    "fx_line_stop": """
select cast(n_nationkey as int) as line_no, cast(p_partkey as int) as pos,
  case when n_nationkey % 5 = 0 and p_partkey = 11 then cast((n_nationkey * 7) % 60 as int)
       else cast((n_nationkey * 7 + p_partkey * (1 + n_nationkey % 3)) % 60 as int) end as stn,
  case when n_nationkey < 10 then 'subway' else 'bus' end as mode,
  case when n_nationkey < 10 then concat('地铁', cast(n_nationkey as string), '号线(甲--乙)')
       when n_nationkey % 4 = 3 then concat(cast(300 + n_nationkey as string), '路(甲--乙)')
       else concat(cast(300 + n_nationkey as string), '路外环(甲--乙)') end as route_name
from nation cross join (select distinct p_partkey % 12 as p_partkey from part) p
""",
    "fx_nodes": """
select distinct concat('S', lpad(cast(stn as string), 2, '0')) as node_id, mode as node_type,
  concat('东门', cast(stn as string)) as station_name,
  cast(116.30 as double) + cast(floor(stn / 10) as double) * cast(0.03 as double) as x,
  cast(39.85 as double) + cast(stn % 10 as double) * cast(0.012 as double) as y
from fx_line_stop
""",
    "fx_edges": """
select cast(line_no * 100 + pos as bigint) as seq, mode as edge_type, route_name, 0 as direction,
  concat('S', lpad(cast(stn as string), 2, '0')) as from_id, concat('S', lpad(cast(nxt as string), 2, '0')) as to_id,
  cast(400 + (line_no * 37 + pos * 53) % 900 as double) as distance,
  cast(400 + (line_no * 37 + pos * 53) % 900 as double) / 8 as travel_time
from (select *, lead(stn) over (partition by line_no order by pos) as nxt from fx_line_stop) e where nxt is not null
union all
select cast(10000 + k * 100 + s as bigint), t, cast(null as string), 0,
  concat('S', lpad(cast(s as string), 2, '0')), concat('S', lpad(cast((s + off) % 60 as string), 2, '0')),
  cast(80 + (s * 31) % 400 as double), cast(80 + (s * 31) % 400 as double) / 1.2
from (select distinct stn as s from fx_line_stop) a cross join
  (select 1 as k, 'bus_transfer' as t, 1 as off, 6 as m union all select 2, 'subway_transfer', 30, 15
   union all select 3, 'intermodal_transfer', 2, 9 union all select 4, 'subway_transfer', 0, 7) b
where s % m = 0
""",
    "fx_taps": """
select /*+ broadcast(o, d) */ cast(l_orderkey as string) as card, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  case when l_partkey % 109 = 0 then '渡轮' when o.mode = 'subway' then '地铁' else '公交' end as o_mode,
  case when l_partkey % 107 = 0 then '地铁' when o.mode = 'subway' then '地铁' else '公交' end as d_mode,
  case when o.mode = 'subway' then concat('地铁', cast(o.line_no as string), '号线')
       when o.line_no = 24 then '999路'
       when o.line_no % 4 = 3 then concat(cast(300 + o.line_no as string), '路快车')
       else concat(cast(300 + o.line_no as string), '路外环') end as o_line,
  case when o.mode = 'subway' then concat('地铁', cast(o.line_no as string), '号线')
       when o.line_no = 24 then '999路'
       when o.line_no % 4 = 3 then concat(cast(300 + o.line_no as string), '路快车')
       else concat(cast(300 + o.line_no as string), '路外环') end as d_line,
  cast(l_linenumber % 2 as int) as o_dir, op + 1 as o_stopno, dp + 1 as d_stopno,
  case when l_linenumber = 7 then concat('未知', cast(o.stn as string))
       when l_linenumber % 2 = 1 then concat('东门', cast(o.stn as string), '站') else concat('东门', cast(o.stn as string)) end as o_name,
  concat('东门', cast(d.stn as string)) as d_name,
  case when l_partkey % 101 = 0 then cast(null as double) else cast(39.85 as double) + cast(o.stn % 10 as double) * cast(0.012 as double)
    + cast(l_partkey % 5 as double) * cast(0.0002 as double) + case when l_discount > 0.095 then 0.5 else 0.0 end end as o_lat,
  cast(116.30 as double) + cast(floor(o.stn / 10) as double) * cast(0.03 as double) as o_lon,
  cast(39.85 as double) + cast(d.stn % 10 as double) * cast(0.012 as double) as d_lat,
  cast(116.30 as double) + cast(floor(d.stn / 10) as double) * cast(0.03 as double) as d_lon,
  case when l_partkey % 103 = 0 then 'bad' else concat('2019-05-13 ', lpad(cast(cast(floor(dep / 3600) as int) as string), 2, '0'), ':',
    lpad(cast(cast(floor(dep / 60) as int) % 60 as string), 2, '0'), ':', lpad(cast(dep % 60 as string), 2, '0')) end as dep,
  concat('2019-05-1', cast(3 + cast(floor((dep + tt) / 86400) as int) as string), ' ',
    lpad(cast(cast(floor((dep + tt) / 3600) as int) % 24 as string), 2, '0'), ':',
    lpad(cast(cast(floor((dep + tt) / 60) as int) % 60 as string), 2, '0'), ':', lpad(cast((dep + tt) % 60 as string), 2, '0')) as arr
from (select *, cast((l_partkey + l_suppkey) % 25 as int) as ln, cast(l_partkey % 12 as int) as op,
        cast((l_partkey + cast(l_quantity as bigint)) % 12 as int) as dp,
        case when (l_partkey + l_suppkey) % 25 < 10
             then cast(floor(((l_orderkey * 37 + l_linenumber * 613 + l_partkey * 7) % 86400) / 60) as int) * 60
             else cast((l_orderkey * 37 + l_linenumber * 613 + l_partkey * 7) % 86400 as int) end as dep,
        case when l_quantity = 50 then 12000 when l_linenumber = 1 and l_tax > 0.075 then 0
             else cast(90 + cast(l_quantity as bigint) % 12 * 140 + l_partkey % 97 * 3 as int) end as tt from lineitem) l
join fx_line_stop o on o.line_no = l.ln and o.pos = l.op join fx_line_stop d on d.line_no = l.ln and d.pos = l.dp
""",
    "fx_trips": """
select o_orderkey as sid, case when o_orderkey % 5 < 2 then 'subway' else 'bus' end as origin_mode,
  cast((o_orderkey * 53) % 86400 as double) as departure_time, cast(floor(((o_orderkey * 53) % 86400) / 3600) as int) as departure_hour,
  case when o_orderkey % 41 = 0 then 'timeout_exit' when o_orderkey % 43 = 0 then 'unfinished' else 'arrived' end as status,
  cast(floor((400 + (o_custkey * 7 + o_orderkey * 11) % 3000) / 10) * 10 as double) as total_time,
  cast(o_orderkey % 240 as double) as first_wait_time, cast(o_orderkey % 240 + o_custkey % 60 as double) as wait_time,
  cast(o_custkey % 90 as double) as walk_time, cast(100 + (o_custkey * 7) % 900 as double) as in_vehicle_time,
  cast(o_orderkey % 3 as int) as num_transfers,
  case when o_orderkey % 7 = 0 then 'Walk' when o_orderkey % 5 < 2 then 'Subway' else 'Bus' end as main_mode,
  case when o_orderkey % 37 = 0 then cast(null as double)
       else cast(400 + (o_custkey * 7 + o_orderkey * 11) % 3000 + o_custkey % 401 - 200 as double) end as observed_tt_s
from orders
""",
    "fx_route_options": """
select l_orderkey as od, cast(l_linenumber as int) as rnk, min(l_extendedprice) / 50 as in_vehicle_time,
  min(l_quantity) * 10 as expected_wait, min(l_tax) * 1000 as walk_time, cast(l_linenumber % 3 as int) as num_transfers
from lineitem group by l_orderkey, l_linenumber
""",
    "fx_names": """
select distinct concat(case when l_partkey % 7 = 0 then '地铁' when l_partkey % 7 = 1 then '夜' else '' end, cast(l_suppkey % 400 as string),
    case l_linenumber when 1 then '路外环' when 2 then '路内环(甲--乙)' when 3 then '快车' when 4 then '号线' when 5 then '路区间定班'
      when 6 then '线支线（东 门--西站）' else ' 路快外 ' end) as line_name,
  case when l_partkey % 50 = 0 then ' nan ' when l_partkey % 51 = 0 then 'T2航站楼' when l_partkey % 53 = 0 then '灵镜胡同站'
    else concat(' 东 ', case when l_suppkey % 3 = 0 then '站' else '' end, cast(l_suppkey as string), case when l_linenumber % 2 = 0 then '站' else '' end) end as station
from lineitem
""",
}


def with_clause(names: list[str], tables: dict[str, str], materialized: str = "") -> str:
    """The named statements and those they build on, in order, as a WITH clause."""
    seen: dict[str, None] = {}

    def visit(name: str) -> None:
        for other in tables:
            if other != name and other not in seen and re.search(rf"\b{other}\b", tables[name]):
                visit(other)
        seen.setdefault(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as {materialized}({tables[n].strip()})" for n in seen)


def _source(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The relation of a given table. A large table whose rows would be read by a few tasks is dealt out first, as a row group is one task."""
    path = f"{sf_dir}/{name}.parquet"
    if name not in LARGE:
        return f"parquet.`{path}`"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    # a row for each task that reads; rows are counted from the files' footers
    held = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if (held["most"] or 0) * cores <= 2 * (held["all"] or 0):
        return f"parquet.`{path}`"
    view = f"dealt_{name}_{zlib.crc32(path.encode())}"
    rows.repartition(max(cores, held["all"] // TASK_ROWS)).createOrReplaceTempView(view)
    return view


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"{with_clause([name], MAPPING)} select * from {name}"
    for t in GIVEN:
        if re.search(rf"\b(from|join) {t}\b", sql):
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {_source(spark, sf_dir, t)} as {t}", sql)
    return spark.sql(sql)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
