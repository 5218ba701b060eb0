"""Modelled against observed travel times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareflow.operators.quantiles import quantile_columns


def comparable(trips: DataFrame) -> DataFrame:
    """Arrived trips with an observation: sim_min and obs_min. Bus cards are read on board, so the first wait doesn't count."""
    seen = trips.where("status = 'arrived' and observed_tt_s is not null")
    sim = F.when(F.col("origin_mode") == "bus", F.col("total_time") - F.col("first_wait_time")).otherwise(F.col("total_time"))
    return seen.withColumns({"sim_min": sim / 60, "obs_min": F.col("observed_tt_s") / 60})


def _with_all(cmp: DataFrame, *columns: str) -> DataFrame:
    """Each row in its mode's group and in `all`."""
    return cmp.select(F.explode(F.array(F.lit("all"), F.col("origin_mode"))).alias("grp"), *columns)


def stats(cmp: DataFrame, min_n: int = 10) -> DataFrame:
    """Errors, means and quantiles in minutes by mode and of all; a group of trips without a mode keeps its null."""
    error = F.col("sim_min") - F.col("obs_min")
    aggregates = [F.count("*").alias("n"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.corr("sim_min", "obs_min").alias("corr")]
    rolled = cmp.rollup("origin_mode").agg(*aggregates, *[F.avg(f"{c}_min").alias(f"{c}_mean") for c in ("sim", "obs")], F.grouping("origin_mode").alias("_all")).where(F.col("n") >= min_n)
    both = F.explode(F.array(F.struct(F.lit(1).alias("_whole"), F.lit(None).cast("string").alias("_mode")), F.struct(F.lit(0).alias("_whole"), F.col("origin_mode").alias("_mode")))).alias("g")
    rows = cmp.select(both, "sim_min", "obs_min").select("g.*", "sim_min", "obs_min")
    middle = quantile_columns(rows, ["_whole", "_mode"], {f"{c}_min": {0.5: f"{c}_median", 0.9: f"{c}_p90"} for c in ("sim", "obs")})
    joined = rolled.join(middle, (F.col("_all") == F.col("_whole")) & F.col("origin_mode").eqNullSafe(F.col("_mode")), "left")
    named = F.when(F.col("_all") == 1, "all").otherwise(F.col("origin_mode")).alias("grp")
    return joined.select(named, *[c for c in joined.columns if c not in ("origin_mode", "_all", "_whole", "_mode")])


def distributions(cmp: DataFrame) -> DataFrame:
    """(grp, x, f_sim, f_obs): both distribution functions at each value that occurs.

    Values are collapsed first (times are whole seconds), so the cumulation sees distinct values only.
    """
    values = _with_all(cmp, "sim_min", "obs_min").select("grp", F.explode(F.array(F.struct(F.col("sim_min").alias("x"), F.lit(1).alias("s")), F.struct(F.col("obs_min").alias("x"), F.lit(0).alias("s")))).alias("v")).select("grp", "v.*")
    counts = values.groupBy("grp", "x").agg(F.sum("s").alias("n_sim"), F.sum(1 - F.col("s")).alias("n_obs"))
    group, so_far = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("x")
    return counts.select("grp", "x", *[(F.sum(f"n_{s}").over(so_far) / F.sum(f"n_{s}").over(group)).alias(f"f_{s}") for s in ("sim", "obs")])


def ks(cmp: DataFrame) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic."""
    return distributions(cmp).groupBy("grp").agg(F.max(F.abs(F.col("f_sim") - F.col("f_obs"))).alias("ks"))


def wasserstein(cmp: DataFrame) -> DataFrame:
    """The area between both distribution functions."""
    table = distributions(cmp)
    width = F.lead("x").over(Window.partitionBy("grp").orderBy("x")) - F.col("x")
    return table.withColumn("w", width).groupBy("grp").agg(F.coalesce(F.sum(F.abs(F.col("f_sim") - F.col("f_obs")) * F.col("w")), F.lit(0.0)).alias("wasserstein"))


def hourly(cmp: DataFrame) -> DataFrame:
    both = [f for s in ("sim", "obs") for f in (F.avg(f"{s}_min").alias(f"{s}_mean"), F.percentile(f"{s}_min", F.lit(0.5)).alias(f"{s}_median"))]
    return cmp.groupBy("origin_mode", "departure_hour").agg(F.count("*").alias("n"), *both)


def cdf(cmp: DataFrame) -> DataFrame:
    """(origin_mode, series, x, p): the points of each distribution."""
    series = [cmp.select("origin_mode", F.lit(s).alias("series"), F.col(f"{s}_min").alias("x")) for s in ("sim", "obs")]
    counts = reduce(DataFrame.unionByName, series).groupBy("origin_mode", "series", "x").agg(F.count("*").alias("n"))
    group = Window.partitionBy("origin_mode", "series")
    return counts.select("origin_mode", "series", "x", (F.sum("n").over(group.orderBy("x")) / F.sum("n").over(group)).alias("p"))


def density(cmp: DataFrame) -> DataFrame:
    return cmp.groupBy(F.floor("obs_min").alias("obs_bin"), F.floor("sim_min").alias("sim_bin")).agg(F.count("*").alias("n"))


def scenarios(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("calibrated", "legacy")) -> DataFrame:
    """Both runs' statistics by group, side by side."""
    one = lambda df, name: stats(df).select("grp", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "mae", "rmse", "sim_mean")])
    left, right = one(a, names[0]), one(b, names[1]).withColumnRenamed("grp", "_grp")
    return left.join(right, F.col("grp").eqNullSafe(F.col("_grp")), "full_outer").withColumn("grp", F.coalesce("grp", "_grp")).drop("_grp")


def calib_parameters(speeds: DataFrame, headways: DataFrame, transfers: DataFrame) -> DataFrame:
    """(mode, name, value): the final parameters of the modes from the three calibrations."""
    mode = speeds.where("scope = 'mode' and period = 'all'")
    parts = [mode.select(F.col("key").alias("mode"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("speed_kmh", "dwell_s", "stop_delay_s", "terminal_hold_s")]
    parts.append(headways.where("scope = 'mode' and hour <> 'all'").select(F.col("key").alias("mode"), F.concat(F.lit("headway_s_"), F.col("hour").cast("string")).alias("name"), F.col("headway_s").alias("value")))
    parts.append(transfers.where("scope = 'mode'").select(F.col("key").alias("mode"), F.lit("transfer_time_s").alias("name"), F.col("transfer_time_s").alias("value")))
    return reduce(DataFrame.unionByName, parts)
