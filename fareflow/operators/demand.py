"""Demand tables and time profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import haversine_m, od_cell, split_node_key, time_bucket


def convert(matched: DataFrame, known: DataFrame, date: str | Column = "2019-05-13", keep: tuple[str, ...] = ()) -> DataFrame:
    """Trips between two different stops of the network. date: one service day, or a column that has it."""
    trips = matched.where("o_key is not null and d_key is not null and o_key <> d_key")
    for side in "od":
        trips = trips.join(known.select(F.col("key").alias(f"{side}_key")), f"{side}_key", "left_semi")
    o, d = split_node_key(F.col("o_key")), split_node_key(F.col("d_key"))
    far = haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")) / 1000
    return trips.select(
        F.col("card").alias("pid"), od_cell(F.col("o_lon"), F.col("o_lat")).alias("o"), od_cell(F.col("d_lon"), F.col("d_lat")).alias("d"), "o_lon", "o_lat", "d_lon", "d_lat",
        (date if isinstance(date, Column) else F.lit(date)).alias("date"), F.col("dep_s").cast("int").alias("time"), o["raw"].alias("origin_id"), o["mode"].alias("origin_type"), d["raw"].alias("destination_id"), d["mode"].alias("destination_type"),
        far.alias("distance"), F.col("tt_adj_s").alias("observed_tt_s"), F.col("line_raw").alias("o_line"), "same_line", "route_name", *keep)


def with_sid(df: DataFrame, order_by: tuple[str, ...], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Numbers rows from 0 in the given order, without a window over rows.

    Ranges of the whole order are sorted each in its own task, so days and busy seconds are split wherever other columns differ; a row's
    place in its range and the rows of the ranges before make its number. `cut` writes the sorted ranges once and reads them back, as a
    second run could draw other ranges.
    """
    ranges = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # Spark puts the partition's number above 33 bits of the place in it
    placed = cut(ranges.withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # one row per range
    sid = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(counts.select("_range", before.alias("_before")), "_range").withColumn("sid", sid).drop("_range", "_before", "_place")


def convert_report(matched: DataFrame, demand: DataFrame) -> DataFrame:
    """One row: rows, with two different ends, in the network, by mode, mean minutes, distinct pairs."""
    two = F.col("o_key").isNotNull() & F.col("d_key").isNotNull() & (F.col("o_key") != F.col("d_key"))
    before = matched.agg(F.count("*").alias("matched_records"), F.sum(two.cast("long")).alias("both_nodes"))
    pair = F.struct("origin_type", "origin_id", "destination_type", "destination_id")
    of = lambda m: F.sum((F.col("origin_type") == m).cast("long")).alias(m)
    after = demand.agg(F.count("*").alias("output_rows"), of("bus"), of("subway"), F.avg(F.col("observed_tt_s") / 60).alias("mean_minutes"), F.countDistinct(pair).alias("od_pairs"))
    return before.crossJoin(after)  # one row each


def hourly_profile(df: DataFrame, time_col: str = "time", mode_col: str = "origin_type") -> DataFrame:
    """24 rows: trips, subway, bus and the share of all; hours beyond the day count as its last or first."""
    hour = F.least(F.greatest(F.floor(F.col(time_col) / 3600), F.lit(0)), F.lit(23)).cast("int")
    counts = df.groupBy(hour.alias("hour")).agg(F.count("*").alias("trips"), *[F.count(F.when(F.col(mode_col) == m, 1)).alias(m) for m in ("subway", "bus")])
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("trips", "subway", "bus")]
    full = hours.join(counts, "hour", "left").select("hour", *zero)
    total = F.sum("trips").over(Window.partitionBy(F.lit(1)))  # 24 rows
    return full.withColumn("share", F.col("trips") / F.greatest(total, F.lit(1)))


def quarter_hour_profile(df: DataFrame, time_col: str = "time") -> DataFrame:
    slot = F.floor(F.col(time_col) / 900)
    return df.groupBy(slot.alias("slot")).agg(F.count("*").alias("trips")).withColumn("start_s", F.col("slot") * 900)


def window(df: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Trips of start <= time < end with both ids, which must differ as they stand, whatever their modes."""
    kept = df.where("time is not null and origin_id is not null and destination_id is not null and origin_id <> destination_id")
    if start is not None:
        kept = kept.where(F.col("time") >= start)
    return kept if end is None else kept.where(F.col("time") < end)


def sample(df: DataFrame, fraction: float, keys: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Exactly round(rows x fraction) rows, the same for the same seed and rows, whatever the partitions.

    Rows are ordered by a hash of seed and keys; counts of its leading 16 bits find where to stop, and
    only the rows of the last such slice are sorted.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    hashed = df.withColumns({"_h": h, "_slice": F.shiftrightunsigned(h, 48)})
    counts = [(r["_slice"], r["count"]) for r in hashed.groupBy("_slice").count().orderBy("_slice").collect()]  # 65,536 at most
    left = round(sum(n for _, n in counts) * fraction)
    for last, n in counts:
        if n >= left:
            break
        left -= n
    else:
        return df
    edge = hashed.where(F.col("_slice") == last).orderBy(F.shiftrightunsigned("_h", 1), "_h", *keys).limit(left)
    return hashed.where(F.col("_slice") < last).unionByName(edge).drop("_h", "_slice")


def typed_key(raw: Column, mode: Column) -> Column:
    """mode:raw, unless raw has a mode already or the mode is unknown."""
    return F.when(raw.contains(":") | mode.isNull(), raw).otherwise(F.concat_ws(":", mode, raw))


def buckets(df: DataFrame, step: int = 10) -> DataFrame:
    """Trips per bucket of departure time and pair of stops."""
    return df.groupBy(
        time_bucket(F.col("time"), step).alias("bucket"), typed_key(F.col("origin_id"), F.col("origin_type")).alias("origin"), typed_key(F.col("destination_id"), F.col("destination_type")).alias("destination")
    ).agg(F.count("*").alias("trips"))


def od_pairs(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct (origin, destination) keys, less those in known."""
    pairs = df.select(typed_key(F.col("origin_id"), F.col("origin_type")).alias("origin"), typed_key(F.col("destination_id"), F.col("destination_type")).alias("destination")).where("origin <> destination").distinct()
    return pairs if known is None else pairs.join(known.select("origin", "destination"), ["origin", "destination"], "left_anti")


def hourly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.floor(F.col("time") / 3600).cast("int").alias("hour")).agg(F.count("*").alias("trips"))
