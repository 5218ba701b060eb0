"""Routes between stops by rounds of joins: each round adds one leg, a ride or a walk, to many states at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tags of a state before any ride, and after a walk that follows a ride; else the tag is the line.
FRESH, WALKED = "", "*"
#: A route's weight is one number: milliseconds of perceived cost first, then boardings, walks and legs.
UNIT, BOARDING, WALK, LEG = 1_000_000, 10_000, 100, 1
Cut = Callable[[DataFrame], DataFrame]


def route_legs(stops: DataFrame, rides: DataFrame, walks: DataFrame) -> DataFrame:
    """(f, t, line, i, j, ms, lo, hi, total, nodes): rides between any two stops of a line, and walks, whose line is null.

    Times are whole milliseconds, so sums are exact. lo and hi are the times at both ends of a ride from the line's
    first stop; a ride that wraps a loop has hi below lo and passes total, the time at the last stop. nodes are the stops
    after f up to t. Of the rides of a line between two stops (it may visit one twice), the fastest stays.
    """
    times = rides.select("line", "pos", "time")
    timed = stops.select("line", "pos", "node").join(times, ["line", "pos"], "left").withColumn("seg", F.coalesce("time", F.lit(0.0)))
    timed = timed.withColumn("at", F.round(F.sum("seg").over(Window.partitionBy("line").orderBy("pos")) * 1000).cast("long"))
    whole = timed.groupBy("line").agg(F.max("at").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("all"))
    a = timed.select("line", F.col("node").alias("f"), F.col("pos").alias("i"), F.col("at").alias("lo"))
    b = timed.select("line", F.col("node").alias("t"), F.col("pos").alias("j"), F.col("at").alias("hi"))
    n, ahead = F.size("all"), F.col("j") > F.col("i")
    loop = (F.col("all")[0] == F.element_at("all", -1)) & (n > 2)
    pairs = a.join(b, "line").join(whole, "line").where((F.col("f") != F.col("t")) & (ahead | loop & (F.col("j") < F.col("i"))))
    ms = F.when(ahead, F.col("hi") - F.col("lo")).otherwise(F.col("total") - F.col("lo") + F.col("hi"))
    # the first and last stop of a loop are one
    nodes = F.when(ahead, F.slice("all", F.col("i") + 2, F.col("j") - F.col("i"))).otherwise(
        F.concat(F.slice("all", F.col("i") + 2, n - 1 - F.col("i")), F.slice("all", F.lit(2), F.col("j"))))
    every = pairs.select("f", "t", "line", F.struct(ms.alias("ms"), "i", "j", "lo", "hi", "total", nodes.alias("nodes")).alias("x"))
    ridden = every.groupBy("f", "t", "line").agg(F.min("x").alias("x")).select("f", "t", "line", "x.*")
    none = {c: F.lit(None).cast(kind) for c, kind in (("line", "string"), ("i", "int"), ("j", "int"), ("lo", "long"), ("hi", "long"), ("total", "long"))}
    walked = walks.where("f <> t").groupBy("f", "t").agg(F.round(F.min("time") * 1000).cast("long").alias("ms"))
    return ridden.unionByName(walked.withColumns({**none, "nodes": F.array("t")}))


def _stepped(states: DataFrame, legs: DataFrame, stations: DataFrame, penalty_s: float) -> DataFrame:
    """states (node, tag, weight, ...) with each leg that goes on from them: columns of `to`, the new tag and weight."""
    change = stations.select(F.col("key").alias("node"), F.round(F.col("transfer_time") * 1000).cast("long").alias("change"))
    legs = legs.select(F.col("f").alias("node"), F.struct("line", "f", "t", "i", "j", "ms", "lo", "hi", "total").alias("leg"), "nodes")
    line, tag, penalty = F.col("leg.line"), F.col("tag"), F.lit(round(penalty_s * 1000)).cast("long")
    on_foot, same = line.isNull(), F.coalesce(line == tag, F.lit(False))
    extra = F.when(on_foot | same | (tag == FRESH), 0).when(tag == WALKED, penalty).otherwise(penalty + F.coalesce("change", F.lit(0).cast("long")))
    weight = F.col("weight") + (F.col("leg.ms") + extra) * UNIT + LEG + F.when(on_foot, WALK).when(same, 0).otherwise(BOARDING)
    to_tag = F.when(on_foot, F.when(tag == FRESH, FRESH).otherwise(WALKED)).otherwise(line)
    return states.join(change, "node", "left").join(legs, "node").withColumns({"to": F.col("leg.t"), "to_tag": to_tag, "to_weight": weight})


def parts_of(weight: Column) -> dict[str, Column]:
    """cost in seconds, boardings and walks of a weight."""
    low = weight % UNIT
    return {"cost": F.floor(weight / UNIT) / 1000, "boardings": F.floor(low / BOARDING).cast("int"), "walks": F.floor(low % BOARDING / WALK).cast("int")}


def search(origins: DataFrame, legs: DataFrame, stations: DataFrame, cut: Cut, penalty_s: float = 180.0, targets: DataFrame | None = None) -> DataFrame:
    """(origin, node, tag, weight, p_node, p_tag, leg): the best way to each state, with the state and the leg it comes from.

    Cost: riding and walking, a penalty for each boarding after the first, and the stop's transfer time when the line
    changes without a walk; of equal costs, fewer boardings, then walks, then legs. Only states that the last round improved
    go on, until none is improved. With targets (origin, node), states dearer than the dearest target of their origin don't
    go on. `cut` writes a frame and reads it back, so that plans stay short and a lost executor costs one round.
    """
    none = F.lit(None).cast("string")
    leg = F.lit(None).cast("struct<line: string, f: string, t: string, i: int, j: int, ms: bigint, lo: bigint, hi: bigint, total: bigint>")
    key = ["origin", "node", "tag"]
    start = origins.select(F.col("key").alias("origin"), F.col("key").alias("node"), F.lit(FRESH).alias("tag"), F.lit(0).cast("long").alias("weight"), F.lit(True).alias("new"), none.alias("p_node"), none.alias("p_tag"), leg.alias("leg"))
    best = cut(start.distinct())
    while not best.where("new").isEmpty():
        tried = _stepped(best.where("new").drop("leg", "p_node", "p_tag", "new"), legs, stations, penalty_s)
        # equal weights have as many legs, so they come in one round; the smallest parent stays
        row = F.struct(F.col("to_weight").alias("weight"), F.lit(True).alias("new"), F.col("node").alias("p_node"), F.col("tag").alias("p_tag"), "leg")
        found = tried.groupBy("origin", F.col("to").alias("node"), F.col("to_tag").alias("tag")).agg(F.min(row).alias("x")).select(*key, "x.*")
        if targets is not None:
            reached = targets.join(best.groupBy("origin", "node").agg(F.min("weight").alias("w")), ["origin", "node"], "left")
            bound = reached.groupBy("origin").agg(F.when(F.count("*") == F.count("w"), F.max("w")).alias("_bound"))
            found = found.join(bound, "origin", "left").where("_bound is null or weight < _bound").drop("_bound")
        both = best.withColumn("new", F.lit(False)).unionByName(found)
        best = cut(both.groupBy(*key).agg(F.min(F.struct("weight", "new", "p_node", "p_tag", "leg")).alias("x")).select(*key, "x.*"))
    return best.drop("new")


def rebuilt(states: DataFrame, ends: DataFrame, cut: Cut) -> DataFrame:
    """ends (origin, node, ...) with weight and path, the legs of the best way there. Pointers to parents are followed twice as far in each round."""
    best = states.groupBy("origin", "node").agg(F.min(F.struct("weight", "tag")).alias("b")).select("origin", "node", "b.*")
    up = states.select("origin", "node", "tag", "p_node", "p_tag", F.when(F.col("leg").isNull(), F.array().cast("array<struct<line: string, f: string, t: string, i: int, j: int, ms: bigint, lo: bigint, hi: bigint, total: bigint>>")).otherwise(F.array("leg")).alias("path"))
    while not (up := cut(up)).where("p_node is not null").isEmpty():
        over = up.select("origin", F.col("node").alias("p_node"), F.col("tag").alias("p_tag"), F.col("p_node").alias("n"), F.col("p_tag").alias("g"), F.col("path").alias("before"))
        joined = up.join(over, ["origin", "p_node", "p_tag"], "left")
        up = joined.select("origin", "node", "tag", F.col("n").alias("p_node"), F.col("g").alias("p_tag"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
    found = ends.join(best, ["origin", "node"]).join(up.select("origin", "node", "tag", "path"), ["origin", "node", "tag"])
    return found.drop("tag")


def shortest(pairs: DataFrame, legs: DataFrame, stations: DataFrame, cut: Cut, penalty_s: float = 180.0) -> DataFrame:
    """(o_key, d_key, weight, path) of the best route of each pair that has one."""
    targets = cut(pairs.select(F.col("o_key").alias("origin"), F.col("d_key").alias("node")).distinct())
    states = search(targets.select(F.col("origin").alias("key")).distinct(), legs, stations, cut, penalty_s, targets)
    return rebuilt(states, targets, cut).select(F.col("origin").alias("o_key"), F.col("node").alias("d_key"), "weight", "path")


def named(path: Column) -> Column:
    """A path as text, which tells any two apart: each leg's line and end; a walk has no line."""
    return F.array_join(F.transform(path, lambda leg: F.concat_ws(">", F.coalesce(leg["line"], F.lit("")), leg["t"])), ";")


def lines_of(path: Column) -> Column:
    return F.transform(F.filter(path, lambda leg: leg["line"].isNotNull()), lambda leg: leg["line"])


def ridden(path: Column) -> Column:
    """(line, lo, hi) of each ride, in times from the line's first stop; a ride that wraps a loop is two of them."""
    span = lambda leg, lo, hi: F.struct(leg["line"].alias("line"), lo.alias("lo"), hi.alias("hi"))
    zero = F.lit(0).cast("long")
    parts = lambda leg: F.when(leg["j"] > leg["i"], F.array(span(leg, leg["lo"], leg["hi"]))).otherwise(F.array(span(leg, leg["lo"], leg["total"]), span(leg, zero, leg["hi"])))
    return F.flatten(F.transform(F.filter(path, lambda leg: leg["line"].isNotNull()), parts))


def _summed(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + of(x))


def shared_ms(a: Column, b: Column) -> Column:
    """Riding time that two routes share, from their spans."""
    both = lambda x, y: F.when(x["line"] == y["line"], F.greatest(F.least(x["hi"], y["hi"]) - F.greatest(x["lo"], y["lo"]), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return _summed(a, lambda x: _summed(b, lambda y: both(x, y)))


def label_lists(origins: DataFrame, legs: DataFrame, stations: DataFrame, cut: Cut, penalty_s: float = 180.0, keep: int = 5) -> DataFrame:
    """(origin, node, tag, weight, name, path): at each state, the `keep` least routes without a loop, one for each sequence of lines.

    A round adds one leg to the routes that came into a list in the round before, and merges lists; it ends when no list
    changes. A route visits no stop twice, passing by included, and rides no line twice in a row.
    """
    state, order = Window.partitionBy("origin", "node", "tag"), ("weight", "name")
    empty = "array<struct<line: string, f: string, t: string, i: int, j: int, ms: bigint, lo: bigint, hi: bigint, total: bigint>>"
    lists = cut(origins.select(F.col("key").alias("origin"), F.col("key").alias("node"), F.lit(FRESH).alias("tag"), F.lit(0).cast("long").alias("weight"), F.lit("").alias("name"), F.array().cast(empty).alias("path"), F.array("key").alias("seen"), F.lit(True).alias("new")).distinct())
    simple = legs.where(F.size(F.array_distinct("nodes")) == F.size("nodes"))
    while True:
        tried = _stepped(lists.where("new"), simple, stations, penalty_s).where("not arrays_overlap(seen, nodes) and not (leg.line is not null and leg.line = tag)")
        # what is dearer than all of a full list can't come into it
        full = lists.groupBy("origin", F.col("node").alias("to"), F.col("tag").alias("to_tag")).agg(F.max("weight").alias("_worst"), F.count("*").alias("_n")).where(F.col("_n") >= keep).drop("_n")
        tried = tried.join(full, ["origin", "to", "to_tag"], "left").where("_worst is null or to_weight <= _worst")
        path = F.concat("path", F.array("leg"))
        added = tried.select("origin", F.col("to").alias("node"), F.col("to_tag").alias("tag"), F.col("to_weight").alias("weight"), F.concat_ws(";", F.when(F.col("name") != "", F.col("name")), F.concat_ws(">", F.coalesce("leg.line", F.lit("")), "leg.t")).alias("name"), path.alias("path"), F.concat("seen", "nodes").alias("seen"), F.lit(True).alias("new"))
        both = lists.withColumn("new", F.lit(False)).unionByName(added).withColumn("lines", F.array_join(lines_of(F.col("path")), "\n"))
        first = both.withColumn("r", F.row_number().over(Window.partitionBy("origin", "node", "tag", "lines").orderBy(*order))).where("r = 1").drop("r", "lines")
        lists = cut(first.withColumn("r", F.row_number().over(state.orderBy(*order))).where(F.col("r") <= keep).drop("r"))
        if lists.where("new").isEmpty():
            return lists.drop("seen", "new")


def candidates(pairs: DataFrame, legs: DataFrame, stations: DataFrame, cut: Cut, penalty_s: float = 180.0, k: int = 5, max_overlap: float = 0.8, keep: int = 5) -> DataFrame:
    """(o_key, d_key, rnk, weight, path): up to k routes of each pair by ascending weight, none sharing more than max_overlap of its
    riding time, or an accepted route's if that is shorter, with an accepted one.

    The pool of a pair is what the label lists hold at its end: not every path, but the `keep` least of each last line, each with
    lines of its own. The first candidate is the best route; where that one visits a stop twice, it is taken as it is, and the others
    have no loop.
    """
    asked = cut(pairs.select("o_key", "d_key").where("o_key <> d_key").distinct())
    lists = label_lists(asked.select(F.col("o_key").alias("key")).distinct(), legs, stations, cut, penalty_s, keep)
    pool = asked.join(lists, (F.col("o_key") == F.col("origin")) & (F.col("d_key") == F.col("node"))).select("o_key", "d_key", "weight", "name", "path")
    best = shortest(asked, legs, stations, cut, penalty_s).withColumn("name", named(F.col("path")))
    # the best route is in the lists unless it has a loop
    least = pool.groupBy("o_key", "d_key").agg(F.min("weight").alias("_least"))
    looped = best.join(least, ["o_key", "d_key"], "left").where("_least is null or weight < _least").drop("_least")
    spans = ridden(F.col("path"))
    pool = pool.unionByName(looped).withColumn("spans", spans).withColumn("ride", _summed(F.col("spans"), lambda x: x["hi"] - x["lo"]))
    sorted_pool = F.array_sort(F.collect_list(F.struct("weight", "name", "path", "spans", "ride"))).alias("pool")
    percent = round(max_overlap * 100)
    apart = lambda x, y: shared_ms(x["spans"], y["spans"]) * 100 <= F.least(x["ride"], y["ride"]) * percent
    taken = lambda kept, x: F.when((F.size(kept) < k) & F.forall(kept, lambda y: apart(x, y)), F.concat(kept, F.array(x))).otherwise(kept)
    grouped = pool.groupBy("o_key", "d_key").agg(sorted_pool)
    kept = grouped.select("o_key", "d_key", F.aggregate("pool", F.slice("pool", 1, 0), taken).alias("kept"))
    return kept.select("o_key", "d_key", F.posexplode("kept").alias("at", "r")).select("o_key", "d_key", (F.col("at") + 1).alias("rnk"), "r.weight", "r.path")


def path_edges(routes: DataFrame, od: Column) -> DataFrame:
    """(od, seq, line, f, t, mode, time): the legs of paths as route edges, for `perceived_cost`, `attributes` and `overlap`."""
    legs = routes.select(od.alias("od"), F.posexplode("path").alias("seq", "leg"))
    mode = F.when(F.col("leg.line").isNull(), "walk").otherwise(F.substring_index("leg.f", ":", 1))
    return legs.select("od", "seq", "leg.line", "leg.f", "leg.t", mode.alias("mode"), (F.col("leg.ms") / 1000).alias("time"))


def overlap(edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """(od, overlap) of two sets of routes as edges (od, f, t, line, time): shared time by the smaller total."""
    keys = ["od", "f", "t", "line"]
    both = edges_a.join(edges_b.select(*keys), keys, "left_semi").groupBy("od").agg(F.sum("time").alias("shared"))
    totals = [e.groupBy("od").agg(F.sum("time").alias(n)) for e, n in ((edges_a, "ta"), (edges_b, "tb"))]
    out = totals[0].join(totals[1], "od", "full_outer").join(both, "od", "left")
    least = F.least(F.coalesce("ta", F.lit(0.0)), F.coalesce("tb", F.lit(0.0)))
    return out.select("od", F.when(least > 0, F.coalesce("shared", F.lit(0.0)) / least).otherwise(0.0).alias("overlap"))


def perceived_cost(edges: DataFrame, transfer_times: DataFrame | None = None, penalty_s: float = 180.0) -> DataFrame:
    """(od, cost) from route edges (od, seq, line or null for a walk, f, time): as in `shortest`."""
    order = Window.partitionBy("od").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = edges.withColumns({"before": F.last("line", ignorenulls=True).over(past), "on_foot": F.lag(F.col("line").isNull()).over(order)})
    if transfer_times is not None:
        marked = marked.join(transfer_times.select(F.col("key").alias("f"), "transfer_time"), "f", "left")
    else:
        marked = marked.withColumn("transfer_time", F.lit(0.0))
    boards = F.col("line").isNotNull() & F.col("before").isNotNull() & ((F.col("line") != F.col("before")) | F.col("on_foot"))
    extra = F.when(boards, penalty_s + F.when(F.col("on_foot"), 0.0).otherwise(F.coalesce("transfer_time", F.lit(0.0)))).otherwise(0.0)
    return marked.groupBy("od").agg(F.sum(F.col("time") + extra).alias("cost"))


def attributes(edges: DataFrame, headways: DataFrame, access_egress_s: float | dict[str, float] = 0.0) -> DataFrame:
    """Per od: times, boardings, transfers, expected wait, access and egress, total, lines and boarding nodes in order, km and type.

    edges: od, seq, line (null for a walk), f, t, time, mode, distance. access_egress_s: one value for both ends together, or by the mode
    with which an end's node key begins. mode_type is 1 for buses only, 2 for subways only, 7 for both, 0 without a vehicle.
    """
    order = Window.partitionBy("od").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = edges.withColumns({"before": F.last("line", ignorenulls=True).over(past), "on_foot": F.lag(F.col("line").isNull()).over(order)})
    boards = F.col("line").isNotNull() & (F.col("before").isNull() | (F.col("line") != F.col("before")) | F.coalesce("on_foot", F.lit(False)))
    joined = marked.withColumn("boards", boards).join(headways.select("line", "headway_s"), "line", "left")
    rides, ride = F.col("line").isNotNull(), lambda m: F.max(F.when(F.col("line").isNotNull() & (F.col("mode") == m), 1).otherwise(0))
    out = joined.groupBy("od").agg(
        F.sum(F.when(rides, F.col("time")).otherwise(0.0)).alias("in_vehicle_time"), F.sum(F.when(rides, 0.0).otherwise(F.col("time"))).alias("walk_time"),
        F.sum(F.col("boards").cast("int")).alias("boardings"), F.sum(F.when(F.col("boards"), F.col("headway_s") / 2).otherwise(0.0)).alias("expected_wait"),
        (F.sum("distance") / 1000).alias("total_distance"), ride("bus").alias("bus"), ride("subway").alias("subway"), F.min_by("f", "seq").alias("first"), F.max_by("t", "seq").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("boards"), F.struct("seq", "line", "f")))).alias("l"))
    if isinstance(access_egress_s, dict):
        at = lambda c: reduce(lambda x, kv: F.when(F.substring_index(c, ":", 1) == kv[0], float(kv[1])).otherwise(x), access_egress_s.items(), F.lit(0.0))
        ends = at("first") + at("last")
    else:
        ends = F.lit(float(access_egress_s))
    kind = F.when((F.col("bus") == 1) & (F.col("subway") == 1), 7).when(F.col("subway") == 1, 2).when(F.col("bus") == 1, 1).otherwise(0)
    return out.withColumn("access_egress_time", ends).select(
        "od", "in_vehicle_time", "walk_time", "boardings", F.greatest(F.col("boardings") - 1, F.lit(0)).alias("num_transfers"), "expected_wait", "access_egress_time",
        (F.col("in_vehicle_time") + F.col("walk_time") + F.col("expected_wait") + F.col("access_egress_time")).alias("total"), "total_distance", kind.alias("mode_type"),
        F.transform("l", lambda x: x["line"]).alias("lines"), F.transform("l", lambda x: x["f"]).alias("boarding_nodes"))


def merge_cache(old: DataFrame, new: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Stored routes and those of pairs that aren't stored yet; asked pairs (o_key, d_key) without a route keep one row of nulls."""
    merged = old.unionByName(new.join(old.select("o_key", "d_key").distinct(), ["o_key", "d_key"], "left_anti"))
    if asked is None:
        return merged
    without = asked.select("o_key", "d_key").distinct().join(merged.select("o_key", "d_key"), ["o_key", "d_key"], "left_anti")
    return merged.unionByName(without, allowMissingColumns=True)


def cache_counts(merged: DataFrame) -> DataFrame:
    """One row: the pairs in the cache, and how many of them have no route."""
    pairs = merged.groupBy("o_key", "d_key").agg(F.max(F.col("lines").isNotNull()).alias("has"))
    return pairs.agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("has"), 1)).alias("without_route"))


def update_cache(path: str, new: DataFrame, asked: DataFrame, slices: int = 64) -> DataFrame:
    """Merges routes of new pairs into the cache at a path, and returns the whole cache, with `slice`, as it is there then.

    The cache is Parquet in `slices` folders by a hash of the pair. Only folders with new pairs are written again; stored pairs stay as they
    are, and asked pairs (o_key, d_key) without a route get one row of nulls.
    """
    spark = new.sparkSession
    at = F.pmod(F.xxhash64("o_key", "d_key"), F.lit(slices)).cast("int").alias("slice")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path)
        known = old.select("o_key", "d_key").distinct()
        fresh = new.join(known, ["o_key", "d_key"], "left_anti")
        added = merge_cache(fresh.limit(0), fresh, asked.join(known, ["o_key", "d_key"], "left_anti")).select("*", at)
        touched = added.select("slice").distinct()
        rows = old.join(touched, "slice", "left_semi").unionByName(added)
    else:
        rows = merge_cache(new.limit(0), new, asked).select("*", at)
    # a slice's rows go to one task each, so a folder has one file
    rows.repartition("slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
    return spark.read.parquet(path)
