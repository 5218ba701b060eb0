"""Transfer times from what trips with one transfer take beyond riding, waiting, access and egress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import period
from fareflow.operators.quantiles import quantiles
from fareflow.operators.routes import parts_of


def _transferring(matched: DataFrame) -> DataFrame:
    return matched.where("mode = 'subway' and not same_line and o_key is not null and d_key is not null and tt_adj_s > 120 and tt_adj_s < 7200")


def top_od(matched: DataFrame, n: int = 4000) -> DataFrame:
    """(o_key, d_key, trips, share): the busiest pairs of trips with a transfer; ties by key. share is of all such trips."""
    counts = _transferring(matched).groupBy("o_key", "d_key").agg(F.count("*").alias("trips"))
    total = counts.agg(F.sum("trips").alias("_all"))
    top = counts.orderBy(F.desc("trips"), "o_key", "d_key").limit(n)
    return top.crossJoin(total).withColumn("share", F.col("trips") / F.col("_all")).drop("_all")


def single_transfer_od(best: DataFrame) -> DataFrame:
    """(o_key, d_key, line1, line2, station, ivt) of the pairs whose best route (weight, path) has two boardings and no walk."""
    parts = parts_of(F.col("weight"))
    one = best.where((parts["boardings"] == 2) & (parts["walks"] == 0))
    line1, line2 = F.col("path")[0]["line"], F.element_at("path", -1)["line"]
    first = F.filter("path", lambda leg: leg["line"] == line1)
    ivt = F.aggregate("path", F.lit(0).cast("long"), lambda s, leg: s + leg["ms"]) / 1000
    return one.select("o_key", "d_key", line1.alias("line1"), line2.alias("line2"), F.element_at(first, -1)["t"].alias("station"), ivt.alias("ivt"))


def residuals(matched: DataFrame, od: DataFrame, access_egress_s: float, per_stop: DataFrame, headways: DataFrame, missing_s: float = 300.0) -> DataFrame:
    """Trips of od (o_key, d_key, line1, line2, ivt, station) with resid, what is left for the transfer.

    per_stop: (period, c) with "all"; headways: (line, hour, headway_s).
    """
    trips = _transferring(matched).join(od, ["o_key", "d_key"]).withColumns({"hour": F.pmod(F.floor(F.col("dep_s") / 3600), F.lit(24)).cast("int"), "period": period(F.col("dep_s"))})
    for k in "12":
        h = headways.select(F.col("line").alias(f"line{k}"), "hour", F.col("headway_s").alias(f"h{k}"))
        trips = trips.join(h, [f"line{k}", "hour"], "left")
    whole = per_stop.where("period = 'all'").select(F.col("c").alias("_c"))
    # one row, and one for a period: the trips of a period stay in many tasks
    trips = trips.join(F.broadcast(per_stop), "period", "left").crossJoin(F.broadcast(whole))
    wait = [0.5 * F.coalesce(f"h{k}", F.lit(missing_s)) for k in "12"]
    made = access_egress_s + 2 * F.coalesce("c", "_c") + F.col("ivt") + wait[0] + wait[1]
    return trips.withColumn("resid", F.col("tt_adj_s") - made).where("resid > -900 and resid < 2400").drop("c", "_c")


def transfer_table(resid: DataFrame, min_obs: int = 100, lo: float = 60, hi: float = 600) -> DataFrame:
    """scope, key, transfer_time_s, n_obs, raw_median_s, q25, q75: overall and by station with enough trips."""
    clipped = F.least(F.greatest("raw_median_s", F.lit(float(lo))), F.lit(float(hi))).alias("transfer_time_s")

    def of(keys: list[str], counts: DataFrame, scope: str, key) -> DataFrame:
        at = {0.25: "q25", 0.5: "raw_median_s", 0.75: "q75"}
        wide = quantiles(resid, keys, "resid", tuple(at)).groupBy(*keys).agg(*[F.max(F.when(F.col("share") == q, F.col("resid"))).alias(n) for q, n in at.items()])
        both = counts.join(wide, keys) if keys else counts.crossJoin(wide)  # one row each
        return both.select(F.lit(scope).alias("scope"), key.alias("key"), clipped, "n_obs", "raw_median_s", "q25", "q75")

    whole = resid.agg(F.count("*").alias("n_obs")).where("n_obs > 0")
    each = resid.groupBy("station").agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= min_obs)
    return of([], whole, "mode", F.lit("subway")).unionByName(of(["station"], each, "station", F.col("station")))


def profile(resid: DataFrame) -> DataFrame:
    """Medians by period, and quantiles of all."""
    by = quantiles(resid, ["period"], "resid", (0.5,)).select(F.concat(F.lit("median_"), "period").alias("name"), F.col("resid").alias("value"))
    whole = quantiles(resid, [], "resid", (0.1, 0.25, 0.5, 0.75, 0.9))
    return by.unionByName(whole.select(F.concat(F.lit("q_"), F.col("share").cast("string")).alias("name"), F.col("resid").alias("value")))
