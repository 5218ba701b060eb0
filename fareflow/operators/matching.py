"""Matching of taps to the network, on distinct combinations that are then joined back to the taps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import haversine_m, line_core_key, line_variant_key, station_name
from fareflow.operators.network import first_stops, legs
from fareflow.operators.quantiles import quantile_columns

OUT = ["o_key", "d_key", "route_name", "o_idx", "d_idx", "route_dist_m", "n_intermediate", "match"]


def _none(c, default: int):
    return F.coalesce(c, F.lit(default)).cast("int")


def subway_pairs(taps: DataFrame, known: DataFrame, stops: DataFrame, rides: DataFrame | None = None) -> DataFrame:
    """Each pair of subway stop names with its ends and the best direct line, the fewest hops first. rides: legs(stops), if made before.

    Of the stops of one name, the first by seq is meant, where the network has seq; else the least key.
    """
    first = F.min_by("key", "seq") if "seq" in known.columns else F.min("key")
    pairs = taps.where("mode = 'subway'").select("o_name", "d_name").distinct()
    named = known.where("mode = 'subway'").groupBy(station_name(F.col("name")).alias("norm")).agg(first.alias("key"))
    for side in "od":
        other = named.select(F.col("norm").alias(f"_{side}"), F.col("key").alias(f"{side}_key"))
        pairs = pairs.join(other, station_name(F.col(f"{side}_name")) == F.col(f"_{side}"), "left").drop(f"_{side}")
    rides = (rides or legs(stops)).where("hops > 0").select(F.col("o").alias("o_key"), F.col("d").alias("d_key"), "line", "i", "j", "hops", "dist", "n_int")
    best = rides.groupBy("o_key", "d_key").agg(F.min_by(F.struct("line", "i", "j", "dist", "n_int"), F.struct("hops", "line", "i", "j")).alias("b"))
    out = pairs.join(best, ["o_key", "d_key"], "left")
    label = F.when(F.col("o_key").isNull() | F.col("d_key").isNull(), "no_station").when(F.col("b").isNull(), "transfer").otherwise("same_line")
    return out.select("o_name", "d_name", "o_key", "d_key", F.col("b.line").alias("route_name"), _none(F.col("b.i"), -1).alias("o_idx"), _none(F.col("b.j"), -1).alias("d_idx"),
                      F.col("b.dist").alias("route_dist_m"), _none(F.col("b.n_int"), -1).alias("n_intermediate"), label.alias("match"))


def bus_groups(taps: DataFrame) -> DataFrame:
    """Each bus line and pair of stop names with the median place of both ends."""
    # taps without a name or a place were left out in cleaning, so each group has a row; bins of some 50 metres
    wanted, keys = {c: {0.5: c} for c in ("o_lon", "o_lat", "d_lon", "d_lat")}, ["line_raw", "o_name", "d_name"]
    # a stop's places repeat, so equal taps are counted first
    counted = taps.where("mode = 'bus'").groupBy(*keys, *wanted).agg(F.count("*").alias("_n"))
    return quantile_columns(counted, keys, wanted, width=0.0005, weight="_n")


def bus_candidates(groups: DataFrame, stops: DataFrame) -> DataFrame:
    """groups with line, line_seq and how: lines of the same variant key; only without any, those of the same core key."""
    lines = stops.where("mode = 'bus'").select("line", "line_seq").distinct()
    raw = groups.select("line_raw").distinct().withColumns({"v": line_variant_key(F.col("line_raw")), "c": F.nullif(line_core_key(F.col("line_raw")), F.lit(""))})
    by_variant = raw.join(lines.withColumn("v", line_variant_key(F.col("line"))), "v").select("line_raw", "line", "line_seq", F.lit("variant").alias("how"))
    left = raw.join(by_variant.select("line_raw"), "line_raw", "left_anti")
    by_core = left.join(lines.withColumn("c", F.nullif(line_core_key(F.col("line")), F.lit(""))), "c").select("line_raw", "line", "line_seq", F.lit("core").alias("how"))
    return groups.join(by_variant.unionByName(by_core), "line_raw", "left").withColumn("how", F.coalesce("how", F.lit("no_line")))


def locate_stops(candidates: DataFrame, known: DataFrame, stops: DataFrame, tol_m: float = 200.0) -> DataFrame:
    """candidates with o_pos, o_how, d_pos, d_how: the first stop of that name, else the nearest within tol_m."""
    at = first_stops(stops).join(known.select(F.col("key").alias("node"), station_name(F.col("name")).alias("norm"), "lon", "lat"), "node")
    places = at.select(F.col("line").alias("_line"), F.col("pos").alias("_pos"), "norm", "lon", "lat")
    keys = ["line_raw", "o_name", "d_name", "line"]
    out = candidates.where("line is not null")
    for side in "od":
        by_name = places.groupBy("_line", "norm").agg(F.min("_pos").alias(f"{side}_named"))
        out = out.join(by_name, (F.col("line") == F.col("_line")) & (station_name(F.col(f"{side}_name")) == F.col("norm")), "left").drop("_line", "norm")
        # only the ends whose name is not on the line are compared with its stops' places
        far = haversine_m(F.col(f"{side}_lat"), F.col(f"{side}_lon"), F.col("lat"), F.col("lon"))
        near = out.where(F.col(f"{side}_named").isNull()).join(places, F.col("line") == F.col("_line")).withColumn("far", far)
        near = near.groupBy(*keys).agg(F.min(F.struct("far", "_pos")).alias("x")).where(F.col("x.far") <= tol_m)
        near = near.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("x._pos").alias(f"{side}_near"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(near, same, "left").drop(*[f"_{k}" for k in keys])
        named, nearest = F.col(f"{side}_named"), F.col(f"{side}_near")
        out = out.withColumns({f"{side}_pos": F.coalesce(named, nearest, F.lit(-1)), f"{side}_how": F.when(named.isNotNull(), "name").when(nearest.isNotNull(), "coord").otherwise("none")}).drop(f"{side}_named", f"{side}_near")
    return out


def bus_pairs(groups: DataFrame, known: DataFrame, stops: DataFrame, tol_m: float = 200.0, rides: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Each group with its best line: both ends by name first, then the fewest hops, then the earlier line.

    rides and candidates: legs(stops) and bus_candidates(groups, stops), if made before.
    """
    candidates = candidates or bus_candidates(groups, stops)
    located = locate_stops(candidates, known, stops, tol_m)
    rides = (rides or legs(stops)).where("hops > 0").select(F.col("line").alias("_l"), F.col("i").alias("_i"), F.col("j").alias("_j"), "o", "d", "hops", "dist", "n_int")
    found = located.join(rides, (F.col("line") == F.col("_l")) & (F.col("o_pos") == F.col("_i")) & (F.col("d_pos") == F.col("_j")))
    keys = ["line_raw", "o_name", "d_name"]
    score = F.struct(F.when((F.col("o_how") == "name") & (F.col("d_how") == "name"), 0).otherwise(1).alias("s"), "hops", "line_seq")
    label = F.concat_ws("_", "how", "o_how", "d_how").alias("match")
    best = found.groupBy(*keys).agg(F.min_by(F.struct("o", "d", "line", "_i", "_j", "dist", "n_int", label), score).alias("b"))
    how = candidates.groupBy(*keys).agg(F.min("how").alias("how"))
    renamed = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = how.join(renamed, same, "left")
    missed = F.when(F.col("how") == "no_line", "no_line").otherwise(F.concat("how", F.lit("_no_stop")))
    return out.select(*keys, F.col("b.o").alias("o_key"), F.col("b.d").alias("d_key"), F.col("b.line").alias("route_name"), _none(F.col("b._i"), -1).alias("o_idx"), _none(F.col("b._j"), -1).alias("d_idx"),
                      F.col("b.dist").alias("route_dist_m"), _none(F.col("b.n_int"), -1).alias("n_intermediate"), F.coalesce("b.match", missed).alias("match"))


def match_taps(taps: DataFrame, known: DataFrame, stops: DataFrame, tol_m: float = 200.0) -> DataFrame:
    """taps with what was found for their combination; null names match like any other value."""
    return join_back(taps, subway_pairs(taps, known, stops), bus_pairs(bus_groups(taps), known, stops, tol_m))


def join_back(taps: DataFrame, subway: DataFrame, bus: DataFrame) -> DataFrame:
    """taps with their combination's columns, from subway_pairs and bus_pairs."""
    subway = subway.withColumns({"_mode": F.lit("subway"), "_line": F.lit(None).cast("string")})
    bus = bus.withColumns({"_mode": F.lit("bus"), "_line": F.col("line_raw")}).drop("line_raw")
    found = subway.unionByName(bus).withColumnsRenamed({"o_name": "_o", "d_name": "_d"})
    line = F.when(F.col("mode") == "bus", F.col("line_raw"))
    on = (F.col("mode") == F.col("_mode")) & F.col("o_name").eqNullSafe(F.col("_o")) & F.col("d_name").eqNullSafe(F.col("_d")) & line.eqNullSafe(F.col("_line"))
    joined = taps.join(found, on, "left").drop("_mode", "_line", "_o", "_d")
    return joined.withColumn("same_line", F.coalesce(F.col("route_name").isNotNull(), F.lit(False)))


def match_report(matched: DataFrame) -> DataFrame:
    """Per mode and label: records, with both ends, on one line."""
    return matched.groupBy("mode", "match").agg(
        F.count("*").alias("n"), F.sum((F.col("o_key").isNotNull() & F.col("d_key").isNotNull()).cast("long")).alias("both_ends"), F.sum(F.col("same_line").cast("long")).alias("same_line"))


def departures_by_hour(matched: DataFrame) -> DataFrame:
    return matched.groupBy("mode", F.floor(F.col("dep_s") / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def in_order(matched: DataFrame, *ties: str) -> DataFrame:
    """For writing: by departure, then by the columns given."""
    return matched.orderBy("dep_s", *ties)


