"""Trip records and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.operators.quantiles import quantile_columns

#: Columns of a trip record that come with the events, by type; where events lack one, it is zero (times and counts) or null.
GIVEN = {
    "passenger_id": "long", "sid": "long", "pid": "string", "origin": "string", "destination": "string", "origin_mode": "string", "destination_mode": "string", "departure_time": "double",
    "arrival_time": "double", "status": "string", "wait_time": "double", "first_wait_time": "double", "walk_time": "double", "in_vehicle_time": "double", "access_egress_time": "double",
    "num_boardings": "int", "mode_type": "int", "route_distance_km": "double", "num_reroutes": "int", "observed_tt_s": "double",
}
ZERO = {"wait_time", "first_wait_time", "walk_time", "in_vehicle_time", "access_egress_time", "num_boardings", "mode_type", "num_reroutes"}


def trip_records(events: DataFrame, cutoff: float) -> DataFrame:
    """One record a trip: what events give, and total_time (to the cutoff for those still on their way), departure_hour, num_transfers and main_mode.

    main_mode comes from edge_modes, the vehicle modes of the route's edges, where events have them.
    """
    def given(name: str, kind: str) -> Column:
        c = F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)
        return (F.coalesce(c, F.lit(0).cast(kind)) if name in ZERO else c).alias(name)

    modes = F.col("edge_modes") if "edge_modes" in events.columns else F.array().cast("array<string>")
    return events.select(
        *(given(n, k) for n, k in GIVEN.items()), (F.coalesce("arrival_time", F.lit(float(cutoff))) - F.col("departure_time")).cast("double").alias("total_time"),
        F.pmod(F.floor(F.col("departure_time") / 3600), F.lit(24)).cast("int").alias("departure_hour"), F.greatest(F.col("num_boardings") - 1, F.lit(0)).cast("int").alias("num_transfers"),
        main_mode(F.coalesce(modes, F.array().cast("array<string>"))).alias("main_mode"))


def main_mode(edge_modes: Column) -> Column:
    """From an array of a route's vehicle modes: Subway if it has as many edges as Bus and any, Bus if any, else Walk."""
    n = lambda m: F.size(F.filter(edge_modes, lambda x: x == m))
    return F.when((n("subway") >= n("bus")) & (n("subway") > 0), "Subway").when(n("bus") > 0, "Bus").otherwise("Walk")


TIMES = {"total_time": "total", "wait_time": "wait", "walk_time": "walk", "in_vehicle_time": "ivt"}


def summary(trips: DataFrame) -> DataFrame:
    """One row: counts by status and minutes of arrived trips."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    minutes = trips.select("status", "num_transfers", *[F.when(F.col("status") == "arrived", F.col(c) / 60).alias(n) for c, n in TIMES.items()])
    transfers = F.avg(F.when(F.col("status") == "arrived", F.col("num_transfers"))).alias("mean_transfers")
    out = minutes.agg(F.count("*").alias("n"), of("arrived"), of("timeout_exit"), of("unfinished"), *[F.avg(n).alias(f"{n}_mean") for n in TIMES.values()], transfers)
    middle = quantile_columns(minutes, [], {n: {0.5: f"{n}_median", 0.9: f"{n}_p90"} for n in TIMES.values()})
    # one row each
    return out.crossJoin(middle).withColumn("completion_rate", F.col("arrived") / F.greatest("n", F.lit(1)))


def by_main_mode(trips: DataFrame) -> DataFrame:
    arrived = trips.where("status = 'arrived'").select("main_mode", "num_transfers", *[(F.col(c) / 60).alias(n) for c, n in TIMES.items()])
    out = arrived.groupBy("main_mode").agg(F.count("*").alias("n"), F.avg("total").alias("total_mean"), F.avg("ivt").alias("ivt_mean"), F.avg("wait").alias("wait_mean"), F.avg("num_transfers").alias("mean_transfers"))
    middle = quantile_columns(arrived, ["main_mode"], {"total": {0.5: "total_median"}}).withColumnRenamed("main_mode", "_m")
    return out.join(middle, F.col("main_mode").eqNullSafe(F.col("_m")), "left").drop("_m")


def vs_observed(trips: DataFrame) -> DataFrame:
    seen = trips.where("status = 'arrived' and observed_tt_s is not null")
    error = F.abs(F.col("total_time") - F.col("observed_tt_s")) / 60
    return seen.agg(F.count("*").alias("n"), F.avg(F.col("total_time") / 60).alias("sim_mean"), F.avg(F.col("observed_tt_s") / 60).alias("obs_mean"), F.avg(error).alias("mae"))


def hourly_snapshot(trips: DataFrame, hours: int = 48) -> DataFrame:
    """At each full hour up to the last: created, arrived and timed out so far, and the rest, who are on their way. Later events don't count."""
    event = lambda t, kind: F.struct(t.alias("t"), F.lit(kind).alias("kind"))
    end = F.col("departure_time") + F.col("total_time")
    kinds = F.array(event(F.col("departure_time"), "created"), event(F.when(F.col("status") == "arrived", end), "arrived"), event(F.when(F.col("status") == "timeout_exit", end), "timed_out"))
    events = trips.select(F.explode(kinds).alias("e")).select("e.*").where("t is not null")
    # an event at t counts from the first full hour at or after t
    mark = F.ceil(F.col("t") / 3600).cast("int")
    counts = events.where(mark <= hours).groupBy(mark.alias("hour")).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("created", "arrived", "timed_out")])
    marks = trips.sparkSession.range(hours + 1).select(F.col("id").cast("int").alias("hour"))
    so_far = Window.partitionBy(F.lit(1)).orderBy("hour")  # one row per hour
    out = marks.join(counts, "hour", "left").select("hour", *[F.sum(F.coalesce(k, F.lit(0))).over(so_far).alias(k) for k in ("created", "arrived", "timed_out")])
    return out.withColumn("active", F.col("created") - F.col("arrived") - F.col("timed_out"))
