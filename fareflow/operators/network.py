"""Network tables: stations, the stops of lines, rides, walks, and the lookups of calibrated values.

Row order is data in the source files, so edges carry `seq`. All network tables are small (a city's
stops and lines) and their joins are left to Spark's own size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import haversine_m, node_key, period_of_hour
from fareflow.params import INTERMODAL_S, TRANSFER_DEFAULT_S, WALK_SPEED

VEHICLES = ("subway", "bus")


def _by_mode(mode: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(mode == k, F.lit(float(v))).otherwise(out)
    return out


def stations(nodes: DataFrame, transfer_defaults: dict[str, float] = TRANSFER_DEFAULT_S) -> DataFrame:
    """key, raw_id, mode, name, lon, lat, transfer_time of the stops of vehicles, and seq, the first place of each, if nodes have one."""
    kept = nodes.where(F.col("node_type").isin(*VEHICLES))
    if "seq" in nodes.columns:
        kept = kept.groupBy("node_type", "node_id", "station_name", "x", "y").agg(F.min("seq").alias("seq"))
    place = ["seq"] if "seq" in nodes.columns else []
    return kept.select(
        node_key(F.col("node_type"), F.col("node_id")).alias("key"), F.col("node_id").cast("string").alias("raw_id"), F.col("node_type").alias("mode"),
        F.col("station_name").alias("name"), F.col("x").alias("lon"), F.col("y").alias("lat"), _by_mode(F.col("node_type"), transfer_defaults).alias("transfer_time"), *place).distinct()


def line_stops(edges: DataFrame, known: DataFrame) -> DataFrame:
    """line, mode, line_seq, pos, node, seg (metres from the stop before), cum: stops in file order.

    Where an edge doesn't begin at the end of the one before, its beginning is a stop of its own, 0 m on.
    """
    keys = known.select("key")
    ride = edges.where(F.col("edge_type").isin(*VEHICLES)).select(
        F.col("route_name").alias("line"), F.col("edge_type").alias("mode"), "seq", "distance",
        node_key(F.col("edge_type"), F.col("from_id")).alias("f"), node_key(F.col("edge_type"), F.col("to_id")).alias("t"))
    ride = ride.join(keys.withColumnRenamed("key", "f"), "f", "left_semi").join(keys.withColumnRenamed("key", "t"), "t", "left_semi")
    in_file = Window.partitionBy("line").orderBy("seq")
    ride = ride.withColumns({"p": F.lag("t").over(in_file), "line_seq": F.min("seq").over(Window.partitionBy("line"))})
    stop = lambda k, node, seg: F.struct(F.lit(k).alias("k"), F.col(node).alias("node"), seg.cast("double").alias("seg"))
    here, there = stop(0, "f", F.lit(0)), stop(1, "t", F.col("distance"))
    linked = F.coalesce(F.col("p") == F.col("f"), F.lit(False))
    stops = ride.select("line", "mode", "line_seq", "seq", F.explode(F.when(linked, F.array(there)).otherwise(F.array(here, there))).alias("s"))
    order = Window.partitionBy("line").orderBy("seq", "k")
    out = stops.select("line", "mode", "line_seq", "seq", "s.*").withColumns({
        "pos": (F.row_number().over(order) - 1).cast("int"), "cum": F.sum("seg").over(order), "n": F.count("*").over(Window.partitionBy("line"))})
    return out.where("n >= 2").select("line", "mode", "line_seq", "pos", "node", "seg", "cum")


def loops(stops: DataFrame) -> DataFrame:
    """line, n (stops), total (metres), is_loop."""
    ends = stops.groupBy("line").agg(F.count("*").alias("n"), F.max("cum").alias("total"), F.min_by("node", "pos").alias("a"), F.max_by("node", "pos").alias("b"))
    return ends.select("line", "n", "total", ((F.col("a") == F.col("b")) & (F.col("n") > 2)).alias("is_loop"))


def station_lines(stops: DataFrame) -> DataFrame:
    return stops.groupBy("node").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def first_stops(stops: DataFrame) -> DataFrame:
    """Each node's first place on a line."""
    return stops.groupBy("line", "mode", "line_seq", "node").agg(F.min("pos").alias("pos"), F.min("cum").alias("cum"))


def legs(stops: DataFrame) -> DataFrame:
    """line, o, d, i, j, hops, dist, n_int for each ordered pair of stops that a ride can join; loops may wrap."""
    at = first_stops(stops)
    a = at.select("line", "mode", "line_seq", F.col("node").alias("o"), F.col("pos").alias("i"), F.col("cum").alias("ca"))
    b = at.select("line", F.col("node").alias("d"), F.col("pos").alias("j"), F.col("cum").alias("cb"))
    ahead = F.col("j") > F.col("i")
    pairs = a.join(b, "line").join(loops(stops), "line").where(ahead | (F.col("is_loop") & (F.col("j") < F.col("i"))))
    hops = F.when(ahead, F.col("j") - F.col("i")).otherwise(F.col("n") - 1 - F.col("i") + F.col("j")).cast("int")
    dist = F.when(ahead, F.col("cb") - F.col("ca")).otherwise(F.col("total") - F.col("ca") + F.col("cb"))
    return pairs.select("line", "mode", "line_seq", "o", "d", "i", "j", hops.alias("hops"), dist.alias("dist"), (hops - 1).alias("n_int"))


def walk_edges(edges: DataFrame, known: DataFrame, walk_speed: float = WALK_SPEED) -> DataFrame:
    """f, t, kind, time: transfers on foot between known stops; of several, bus comes first, then subway, then intermodal."""
    pairs = lambda *p: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in p])
    kinds = {"bus_transfer": (("bus", "bus"),), "subway_transfer": (("subway", "subway"),), "intermodal_transfer": (("subway", "bus"), ("bus", "subway"))}
    modes, rank = F.array().cast("array<struct<a: string, b: string>>"), F.lit(9)
    for k, (kind, p) in enumerate(kinds.items()):
        modes, rank = F.when(F.col("edge_type") == kind, pairs(*p)).otherwise(modes), F.when(F.col("edge_type") == kind, k).otherwise(rank)
    tried = edges.select("edge_type", "seq", "from_id", "to_id", "distance", rank.alias("rank"), F.posexplode(modes).alias("turn", "m"))
    tried = tried.select("*", node_key(F.col("m.a"), F.col("from_id")).alias("f"), node_key(F.col("m.b"), F.col("to_id")).alias("t")).where("f <> t")
    keys = known.select("key")
    tried = tried.join(keys.withColumnRenamed("key", "f"), "f", "left_semi").join(keys.withColumnRenamed("key", "t"), "t", "left_semi")
    time = F.coalesce("distance", F.lit(0.0)) / walk_speed
    first = tried.groupBy("f", "t").agg(F.min_by(F.struct(F.col("edge_type").alias("kind"), time.alias("time")), F.struct("rank", "seq", "turn")).alias("x"))
    return first.select("f", "t", "x.kind", "x.time")


def shared_id_edges(known: DataFrame, walk: DataFrame, intermodal_s: float = INTERMODAL_S, walk_speed: float = WALK_SPEED) -> DataFrame:
    """Walks both ways between stops of the two modes that share an id and have no walk yet."""
    a, b = known.alias("a"), known.alias("b")
    both = a.join(b, (F.col("a.raw_id") == F.col("b.raw_id")) & (F.col("a.mode") != F.col("b.mode")))
    far = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / walk_speed
    new = both.select(F.col("a.key").alias("f"), F.col("b.key").alias("t"), F.lit("shared_id").alias("kind"), F.greatest(far, F.lit(float(intermodal_s))).alias("time"))
    return new.join(walk.select("f", "t"), ["f", "t"], "left_anti")


def speed_lookup(lines: DataFrame, speeds: DataFrame, mode_defaults: dict[str, float], dwell_defaults: dict[str, float]) -> DataFrame:
    """lines (line, mode, period) with speed_kmh, dwell_s, stop_delay_s, terminal_hold_s.

    Line and period, line, mode and period, mode, then the default; a speed of 0 is passed over, too.
    """
    out, found = lines, {"speed_kmh": [], "dwell_s": [], "stop_delay_s": [], "terminal_hold_s": []}
    for k, (scope, key, when) in enumerate((("line", "line", "period"), ("line", "line", None), ("mode", "mode", "period"), ("mode", "mode", None))):
        part = speeds.where(F.col("scope") == scope).select(F.col("key").alias(key), F.col("period").alias(f"_p{k}"), *[F.col(c).alias(f"_{c}{k}") for c in found])
        on = (out[key] == part[key]) & (part[f"_p{k}"] == (out[when] if when else F.lit("all")))
        out = out.join(part, on, "left").drop(part[key]).drop(f"_p{k}")
        for c, cols in found.items():
            cols.append(F.nullif(F.col(f"_{c}{k}"), F.lit(0.0)) if c == "speed_kmh" else F.col(f"_{c}{k}"))
    mode = F.col("mode")
    last = {"speed_kmh": _by_mode(mode, mode_defaults), "dwell_s": _by_mode(mode, dwell_defaults), "stop_delay_s": F.lit(0.0), "terminal_hold_s": F.lit(0.0)}
    return out.select(*lines.columns, *[F.coalesce(*cols, last[c]).alias(c) for c, cols in found.items()])


def segment_times(stops: DataFrame, params: DataFrame) -> DataFrame:
    """line, period, pos, node, seg and time, the seconds from the stop before (null for the first)."""
    time = F.when(F.col("pos") > 0, F.col("seg") / (F.col("speed_kmh") / 3.6) + F.col("stop_delay_s"))
    return stops.join(params.drop("mode"), "line").select("line", "mode", "period", "pos", "node", "seg", time.alias("time"), "dwell_s", "terminal_hold_s")


def vehicle_edges(segments: DataFrame) -> DataFrame:
    """Ride times between neighbours; the dwell time is added on each segment but a line's first."""
    w = Window.partitionBy("line", "period").orderBy("pos")
    edges = segments.withColumn("f", F.lag("node").over(w)).where("pos > 0")
    return edges.select("line", "mode", "period", "pos", "f", F.col("node").alias("t"), "seg", (F.col("time") + F.when(F.col("pos") > 1, F.col("dwell_s")).otherwise(0.0)).alias("time"))


def headway_lookup(wanted: DataFrame, headways: DataFrame, by_hour: dict[str, dict[int, float]], last: float = 600.0, floor_s: float = 10.0) -> DataFrame:
    """wanted (line, mode, hour) with headway_s.

    Line and hour, line, mode and hour, mode; else the configured hour that is nearest (the smaller of two).
    """
    out, found = wanted, []
    for k, (scope, when) in enumerate((("line", "hour"), ("line", None), ("mode", "hour"), ("mode", None))):
        part = headways.where(F.col("scope") == scope).select(F.col("key").alias(f"_k{k}"), F.col("hour").alias(f"_h{k}"), F.col("headway_s").alias(f"_v{k}"))
        out = out.join(part, (out[scope] == part[f"_k{k}"]) & (part[f"_h{k}"] == (out[when].cast("string") if when else F.lit("all"))), "left").drop(f"_k{k}", f"_h{k}")
        found.append(F.col(f"_v{k}"))
    nearest = F.lit(None).cast("double")
    for mode, hours in by_hour.items():
        listed = F.array(*[F.struct(F.abs(F.col("hour") - h).alias("far"), F.lit(h).alias("h"), F.lit(float(v)).alias("v")) for h, v in sorted(hours.items())])
        nearest = F.when(F.col("mode") == mode, F.array_min(listed)["v"]).otherwise(nearest)
    return out.select(*wanted.columns, F.greatest(F.coalesce(*found, nearest, F.lit(float(last))), F.lit(float(floor_s))).alias("headway_s"))


def headway_average(lines: DataFrame, headways: DataFrame, by_hour, service: tuple[float, float] = (5.0, 23.5)) -> DataFrame:
    """line, mode, headway_s: the mean over the hours of service."""
    hours = F.explode(F.sequence(F.lit(int(service[0])), F.lit(int(-(-service[1] // 1)) - 1))).alias("hour")
    return headway_lookup(lines.select("line", "mode", hours), headways, by_hour).groupBy("line", "mode").agg(F.avg("headway_s").alias("headway_s"))


def apply_transfer_times(known: DataFrame, transfers: DataFrame) -> DataFrame:
    """stations with the transfer times of a table (seq, scope, key, transfer_time_s); a later row overwrites an earlier one."""
    t = transfers.select("seq", "scope", F.col("key").alias("_key"), F.col("transfer_time_s").alias("_t")).where("_t is not null")
    on = ((t["scope"] == "mode") & (known["mode"] == t["_key"])) | ((t["scope"] == "station") & (known["key"] == t["_key"]))
    last = known.select("key", "mode").join(t, on).groupBy("key").agg(F.max_by("_t", "seq").alias("_t"))
    return known.join(last, "key", "left").withColumn("transfer_time", F.coalesce("_t", "transfer_time")).drop("_t")


def resolve_nodes(df: DataFrame, known: DataFrame, ident: str = "ident", mode: str = "mode") -> DataFrame:
    """df with key: a key as it is; an id with its mode; an id alone if only one stop has it; else null."""
    keys = known.select(F.col("key").alias("_a"))
    single = known.groupBy("raw_id").agg(F.count("*").alias("_n"), F.min("key").alias("_c")).where("_n = 1").select("raw_id", "_c")
    out = df.join(keys, df[ident] == keys["_a"], "left")
    with_mode = keys.withColumnRenamed("_a", "_b")
    out = out.join(with_mode, node_key(F.col(mode), F.col(ident)) == F.col("_b"), "left").join(single, out[ident] == single["raw_id"], "left")
    return out.withColumn("key", F.coalesce("_a", F.when(F.col(mode).isNotNull(), F.col("_b")).otherwise(F.col("_c")))).drop("_a", "_b", "_c", "raw_id")


def stations_by_name(known: DataFrame, mode: str | None = None) -> DataFrame:
    kept = known if mode is None else known.where(F.col("mode") == mode)
    return kept.groupBy("name").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def summary(known: DataFrame, stops: DataFrame, walk: DataFrame, rides: DataFrame) -> DataFrame:
    """One row of counts."""
    count = lambda df, name, cond=None: df.agg((F.count("*") if cond is None else F.sum(cond.cast("long"))).alias(name))
    lines = stops.select("line", "mode").distinct()
    parts = [count(known, "stations"), count(stops, "stops"), count(lines, "subway_lines", F.col("mode") == "subway"), count(lines, "bus_lines", F.col("mode") == "bus"), count(walk, "walk_edges"), count(rides, "vehicle_edges")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def line_periods(stops: DataFrame) -> DataFrame:
    """(line, mode, period) for each line and each period, and for all day."""
    return stops.select("line", "mode").distinct().withColumn("period", F.explode(F.array(*map(F.lit, ("all", "am_peak", "pm_peak", "off_peak", "night")))))


def hours_of_lines(stops: DataFrame) -> DataFrame:
    lines = stops.select("line", "mode").distinct()
    return lines.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("period", period_of_hour(F.col("hour")))
