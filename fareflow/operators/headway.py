"""Headways: from clusters of bus taps at busy stops, and from what subway trips take beyond riding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareflow.operators.quantiles import quantiles
from fareflow.params import PERIOD_HOURS, SUBWAY_HEADWAY_PRIOR_S


def top_stops(matched: DataFrame, min_taps: int = 40, n: int = 6) -> DataFrame:
    """Each bus route's busiest boarding stops; ties go to the lower key."""
    counts = matched.where("mode = 'bus' and route_name is not null and o_key is not null").groupBy("route_name", "o_key").agg(F.count("*").alias("taps")).where(F.col("taps") >= min_taps)
    order = Window.partitionBy("route_name").orderBy(F.desc("taps"), "o_key")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tap_clusters(taps: DataFrame, gap_s: float = 90, days: tuple[str, ...] = ()) -> DataFrame:
    """(route_name, o_key, cluster, center, taps): taps with gaps up to gap_s are one vehicle; its time is their median.

    Taps of one second are counted first, so that a stop and day have no more rows to put in order than seconds.
    days: the column of the service day, where taps are of several; clusters are numbered by day then and have it.
    """
    keys = ["route_name", "o_key", *days]
    line = Window.partitionBy(*keys).orderBy("dep_s")
    starts = F.coalesce(F.col("dep_s") - F.lag("dep_s").over(line) > gap_s, F.lit(True))
    marked = taps.groupBy(*keys, "dep_s").agg(F.count("*").alias("n")).withColumn("first", starts.cast("int"))
    numbered = marked.withColumn("cluster", F.sum("first").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.percentile("dep_s", F.lit(0.5), F.col("n")).alias("center"), F.sum("n").alias("taps"))


def cluster_gaps(clusters: DataFrame, min_clusters: int = 3, lo: float = 60, hi: float = 3600, days: tuple[str, ...] = ()) -> DataFrame:
    """(route_name, o_key, hour, gap): gaps to the next cluster of the day by the earlier one's hour, from hours with enough of them."""
    keys = ["route_name", "o_key", *days]
    order = Window.partitionBy(*keys).orderBy("cluster")
    hour = F.pmod(F.floor(F.col("center") / 3600), F.lit(24)).cast("int")
    gaps = clusters.select(*keys, hour.alias("hour"), (F.lead("center").over(order) - F.col("center")).alias("gap")).where("gap is not null")
    enough = F.count("*").over(Window.partitionBy(*keys, "hour"))
    return gaps.withColumn("n", enough).where((F.col("n") >= min_clusters - 1) & F.col("gap").between(lo, hi)).drop("n")


def bus_line_hour(gaps: DataFrame, clusters: DataFrame, min_clusters: int = 3, days: tuple[str, ...] = ()) -> DataFrame:
    """Per route and hour: the median gap of all days, but no more than the clusters of the busiest stop and day allow."""
    keys = ["route_name", "o_key", *days]
    hour = F.pmod(F.floor(F.col("center") / 3600), F.lit(24)).cast("int")
    per_stop = clusters.withColumn("in_stop", F.count("*").over(Window.partitionBy(*keys))).where("in_stop >= 2").groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("n"))
    most = per_stop.groupBy("route_name", "hour").agg(F.max("n").alias("most"))
    medians = gaps.groupBy("route_name", "hour").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap_s"), F.count("*").alias("n_obs")).where(F.col("n_obs") >= min_clusters - 1)
    out = medians.join(most, ["route_name", "hour"], "left").withColumn("upper_from_clusters_s", 3600.0 / F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)))
    return out.withColumn("headway_s", F.least("median_gap_s", F.greatest("upper_from_clusters_s", F.lit(60.0)))).drop("most")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The lower weighted median: the first value at which half of the weight is reached."""
    collapsed = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    reached = F.sum("_w").over(group.orderBy(value)) >= 0.5 * F.sum("_w").over(group)
    total = F.sum("_w").alias("total")
    return collapsed.withColumn("_ok", reached).groupBy(*by).agg(F.min(F.when(F.col("_ok"), F.col(value))).alias(value), total)


def bus_mode(line_hour: DataFrame) -> DataFrame:
    """(hour, headway_s, n_obs) over all routes, for each hour and for "all"."""
    hours = weighted_median(line_hour, ["hour"], "headway_s", "n_obs").select(F.col("hour").cast("string").alias("hour"), "headway_s", F.col("total").alias("n_obs"))
    whole = weighted_median(line_hour.withColumn("hour", F.lit("all")), ["hour"], "headway_s", "n_obs").select("hour", "headway_s", F.col("total").alias("n_obs"))
    return hours.unionByName(whole)


QUANTILES = (0.02, 0.05, 0.08, 0.1, 0.25, 0.5)


def access_egress(matched: DataFrame, speed_kmh: float, dwell_s: float) -> DataFrame:
    """(q, seconds): quantiles of what one-stop subway trips take beyond riding and one dwell."""
    rides = matched.where("mode = 'subway' and same_line and n_intermediate = 0 and route_dist_m > 300")
    left = F.col("tt_adj_s") - F.col("route_dist_m") / (speed_kmh / 3.6) - dwell_s
    return quantiles(rides.select(left.alias("seconds")).where("seconds > 0 and seconds < 3600"), [], "seconds", QUANTILES).select(F.col("share").alias("q"), "seconds")


def subway(fits: DataFrame, access_egress_s: float, mode: str = "prior", lo: float = 120, hi: float = 900) -> DataFrame:
    """fits (scope, key, period, intercept_s, dwell_s, n_obs) as rows by hour: headway_s and the access and egress that it leaves.

    implied: twice what the intercept holds beyond access, egress and a dwell; prior: a fixed value by period.
    """
    implied = F.least(F.greatest(2 * (F.col("intercept_s") - access_egress_s - F.col("dwell_s")), F.lit(float(lo))), F.lit(float(hi)))
    prior = F.lit(SUBWAY_HEADWAY_PRIOR_S["all"])
    for period, value in SUBWAY_HEADWAY_PRIOR_S.items():
        prior = F.when(F.col("period") == period, value).otherwise(prior)
    value = implied if mode == "implied" else prior
    effective = F.lit(float(access_egress_s)) if mode == "implied" else F.least(F.greatest(F.col("intercept_s") - F.col("dwell_s") - value / 2, F.lit(60.0)), F.lit(900.0))
    hours = F.array(F.lit("all"))
    for period, listed in PERIOD_HOURS.items():
        hours = F.when(F.col("period") == period, F.array(*[F.lit(str(h)) for h in listed])).otherwise(hours)
    kept = fits.where((F.col("scope") == "mode") | F.col("key").startswith("地铁") | F.col("key").startswith("首都机场线"))
    tag = "subway_wait_intercept" if mode == "implied" else "subway_prior"
    return kept.select("scope", "key", F.explode(hours).alias("hour"), value.alias("headway_s"), effective.alias("access_egress_s"), "n_obs", F.lit(tag).alias("method"))


def headway_table(mode_rows: DataFrame, bus: DataFrame, subway_rows: DataFrame) -> DataFrame:
    """One table of scope, key, hour, headway_s, n_obs, method and, for bus lines, median_gap_s and upper_from_clusters_s."""
    modes = mode_rows.select(F.lit("mode").alias("scope"), F.lit("bus").alias("key"), "hour", "headway_s", "n_obs", F.lit("bus_tapin_clusters").alias("method"))
    lines = bus.select(F.lit("line").alias("scope"), F.col("route_name").alias("key"), F.col("hour").cast("string").alias("hour"), "headway_s", "n_obs", F.lit("bus_tapin_clusters").alias("method"), "median_gap_s", "upper_from_clusters_s")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [modes, lines, subway_rows.drop("access_egress_s")])
