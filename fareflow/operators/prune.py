"""Pruning of a network by the evidence in matched taps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import line_variant_key, node_key


def station_evidence(matched: DataFrame, known: DataFrame, min_taps: int = 20, allow: tuple[str, ...] = ()) -> DataFrame:
    """Each subway station with its taps as origin or destination, and whether it stays."""
    ends = matched.where("mode = 'subway'").select(F.explode(F.array("o_key", "d_key")).alias("key")).where("key is not null")
    taps = ends.groupBy("key").agg(F.count("*").alias("taps"))
    out = known.where("mode = 'subway'").join(taps, "key", "left").withColumn("taps", F.coalesce("taps", F.lit(0)))
    return out.select("key", "name", "taps", ((F.col("taps") >= min_taps) | F.col("name").isin(*allow)).alias("kept"))


def line_evidence(matched: DataFrame, edges: DataFrame, min_trips: int = 10) -> DataFrame:
    """Each bus route with the trips of its variant key, both directions together, and whether it stays."""
    trips = matched.where("mode = 'bus' and route_name is not null").groupBy("route_name").agg(F.count("*").alias("n"))
    by_key = trips.groupBy(line_variant_key(F.col("route_name")).alias("key")).agg(F.sum("n").alias("trips"))
    routes = edges.where("edge_type = 'bus'").select("route_name").distinct().withColumn("key", line_variant_key(F.col("route_name")))
    out = routes.join(by_key, "key", "left").withColumn("trips", F.coalesce("trips", F.lit(0)))
    return out.select("route_name", "key", "trips", (F.col("trips") >= min_trips).alias("kept"))


def closed_lines(edges: DataFrame, known: DataFrame, patterns: tuple[str, ...], exclude: dict[str, list[str]]) -> DataFrame:
    """(route_name, closed, key): each route's stops, those left out on lines of a prefix marked closed, and all stops of closed routes."""
    ends = edges.where(F.col("edge_type").isin("subway", "bus")).select("route_name", F.explode(F.array(node_key(F.col("edge_type"), F.col("from_id")), node_key(F.col("edge_type"), F.col("to_id")))).alias("key")).distinct()
    closed = reduce(lambda a, b: a | b, [F.col("route_name").rlike(p) for p in patterns], F.lit(False))
    for prefix, names in exclude.items():
        closed = closed | (F.col("route_name").startswith(prefix) & F.col("name").isin(*names))
    return ends.join(known.select("key", "name"), "key").select("route_name", "key", closed.alias("closed"))


def line_runs(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Kept edges of vehicle lines: route_name (with _seg{k} if a line falls apart), from_key, to_key, distance, travel_time.

    status has (route_name, key, status): keep, pass (no stop: joined to the next segment) or cut (the line
    ends there and may begin anew behind); a missing status is cut. A run begins at an edge's beginning that
    is kept. Where an edge doesn't begin at the end of the one before, the run goes on from the stop before.
    """
    ride = edges.where(F.col("edge_type").isin("subway", "bus"))
    event = lambda k, node, d, t: F.struct(F.lit(k).alias("k"), node_key(F.col("edge_type"), F.col(node)).alias("key"), d.cast("double").alias("d"), t.cast("double").alias("t"))
    zero = F.lit(0.0)
    events = ride.select("route_name", "seq", F.explode(F.array(event(0, "from_id", zero, zero), event(1, "to_id", F.col("distance"), F.col("travel_time")))).alias("e")).select("route_name", "seq", "e.*")
    events = events.join(status, ["route_name", "key"], "left").withColumn("status", F.coalesce("status", F.lit("cut")))
    line = Window.partitionBy("route_name").orderBy("seq", "k")
    island = Window.partitionBy("route_name", "island")
    place = F.struct("seq", "k")
    events = events.withColumns({"island": F.sum((F.col("status") == "cut").cast("int")).over(line), "cd": F.sum("d").over(line), "ct": F.sum("t").over(line)})
    events = events.withColumn("start", F.min(F.when((F.col("k") == 0) & (F.col("status") == "keep"), place)).over(island))
    points = events.where((F.col("status") == "keep") & ((place == F.col("start")) | ((F.col("k") == 1) & (place > F.col("start")))))
    order = island.orderBy("seq", "k")
    runs = points.withColumns({"from_key": F.lag("key").over(order), "pd": F.lag("cd").over(order), "pt": F.lag("ct").over(order)}).where("from_key is not null")
    whole = Window.partitionBy("route_name")
    runs = runs.withColumn("k_run", F.dense_rank().over(whole.orderBy("island"))).withColumn("n_runs", F.max("k_run").over(whole))
    name = F.when(F.col("n_runs") > 1, F.concat("route_name", F.lit("_seg"), F.col("k_run").cast("string"))).otherwise(F.col("route_name"))
    return runs.select(name.alias("route_name"), "seq", "from_key", F.col("key").alias("to_key"), (F.col("cd") - F.col("pd")).alias("distance"), (F.col("ct") - F.col("pt")).alias("travel_time"))


def kept_nodes(known: DataFrame, runs: DataFrame) -> DataFrame:
    """Stations that occur in kept vehicle edges."""
    ends = runs.select(F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
    return known.join(ends, "key", "left_semi")


def kept_transfers(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Transfer edges of which both ends stay; an intermodal one may run either way."""
    ways = {"subway_transfer": (("subway", "subway"),), "bus_transfer": (("bus", "bus"),), "intermodal_transfer": (("subway", "bus"), ("bus", "subway"))}
    keys, parts = kept.select("key"), []
    for kind, pairs in ways.items():
        for a, b in pairs:
            e = edges.where(F.col("edge_type") == kind).withColumns({"f": node_key(F.lit(a), F.col("from_id")), "t": node_key(F.lit(b), F.col("to_id"))})
            e = e.join(keys.withColumnRenamed("key", "f"), "f", "left_semi").join(keys.withColumnRenamed("key", "t"), "t", "left_semi")
            parts.append(e.select("seq", "edge_type", "from_id", "to_id", "distance"))
    return reduce(DataFrame.unionByName, parts).distinct()


def statuses(edges: DataFrame, known: DataFrame, evidence: DataFrame, lines: DataFrame, patterns=(), exclude=None, passes: tuple[str, ...] = ()) -> DataFrame:
    """(route_name, key, status): excluded is cut, then observed is keep, then the pass list; buses keep all stops of kept lines."""
    marks = closed_lines(edges, known, patterns, exclude or {}).join(known.select("key", "name", "mode"), "key")
    marks = marks.join(evidence.select("key", F.col("kept").alias("seen")), "key", "left").join(lines.select("route_name", F.col("kept").alias("runs")), "route_name", "left")
    subway = F.when(F.col("closed"), "cut").when(F.coalesce("seen", F.lit(False)), "keep").when(F.col("name").isin(*passes), "pass").otherwise("cut")
    return marks.select("route_name", "key", F.when(F.col("mode") == "subway", subway).when(F.coalesce("runs", F.lit(False)), "keep").otherwise("cut").alias("status"))


def prune_report(known: DataFrame, edges: DataFrame, kept: DataFrame, runs: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: stations and edges before and after, and the names of the stations that went."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    gone = known.join(kept.select("key"), "key", "left_anti").agg(F.concat_ws(",", F.array_sort(F.collect_list("key"))).alias("dropped"))
    return n(known, "nodes_before").join(n(kept, "nodes_after")).join(n(edges, "edges_before")).join(n(runs.select("seq").unionAll(transfers.select("seq")), "edges_after")).join(gone)
