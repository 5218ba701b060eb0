"""Cleaning of raw tap-in/tap-out records: narrow filters and projections, no shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.params import BBOX, MODES

NEEDED = ["o_lat", "o_lon", "d_lat", "d_lon", "dep", "arr"]


def drop_missing(df: DataFrame) -> DataFrame:
    return df.dropna(subset=NEEDED)


def inside(bbox=BBOX) -> Column:
    """Both ends in the box, borders included."""
    low_lat, low_lon, high_lat, high_lon = bbox
    lat = F.col("o_lat").between(low_lat, high_lat) & F.col("d_lat").between(low_lat, high_lat)
    return lat & F.col("o_lon").between(low_lon, high_lon) & F.col("d_lon").between(low_lon, high_lon)


def in_bbox(df: DataFrame, bbox=BBOX) -> DataFrame:
    return df.where(inside(bbox))


def with_times(df: DataFrame, date: str | None = None) -> DataFrame:
    """dep_s, arr_s and tt_s in seconds of the departure's day; rows with unreadable times go. `date` names a column for that day, as text."""
    read = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))
    # by a generator, so that later filters don't have the times read again
    parsed = df.select("*", F.inline(F.array(F.struct(read("dep").alias("_dep"), read("arr").alias("_arr"))))).where("_dep is not null and _arr is not null")
    day = F.unix_timestamp(F.to_date("_dep").cast("timestamp"))
    timed = parsed.withColumns({"dep_s": (F.unix_timestamp("_dep") - day).cast("double"), "arr_s": (F.unix_timestamp("_arr") - day).cast("double")})
    if date is not None:
        timed = timed.withColumn(date, F.date_format("_dep", "yyyy-MM-dd"))
    return timed.withColumn("tt_s", F.col("arr_s") - F.col("dep_s")).drop("_dep", "_arr")


def mode_of(c: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(MODES.items())))[c]


def valid(max_tt_s: float = 10800) -> Column:
    """A known mode at both ends alike, a positive travel time up to the limit, no bus trip to its own stop."""
    same_stop = (mode_of(F.col("o_mode")) == "bus") & F.coalesce(F.col("o_name") == F.col("d_name"), F.lit(False))
    return mode_of(F.col("o_mode")).isNotNull() & (F.col("o_mode") == F.col("d_mode")) & (F.col("tt_s") > 0) & (F.col("tt_s") <= max_tt_s) & ~same_stop


def valid_trips(df: DataFrame, max_tt_s: float = 10800) -> DataFrame:
    return df.where(valid(max_tt_s)).withColumn("mode", mode_of(F.col("o_mode")))


def adjust_tt(df: DataFrame, subway_adj_s: float = -30.0) -> DataFrame:
    """Subway entries are known to the minute only, so half a minute is taken off."""
    return df.withColumn("tt_adj_s", F.when(F.col("mode") == "subway", F.col("tt_s") + subway_adj_s).otherwise(F.col("tt_s")))


CANONICAL = ["card", "mode", "line_raw", "o_name", "d_name", "o_lon", "o_lat", "d_lon", "d_lat", "dep_s", "arr_s", "tt_s", "tt_adj_s"]
#: As in the raw records, where these have them.
CARRIED = {"o_line": "string", "d_line": "string", "o_dir": "smallint", "o_stopno": "smallint", "d_stopno": "smallint"}


def clean_taps(df: DataFrame, bbox=BBOX, max_tt_s: float = 10800, keep: tuple[str, ...] = (), date: str | None = None) -> DataFrame:
    """The whole chain and the canonical columns; `keep` names further columns to carry, `date` a column for the service day, for records of several days."""
    trips = adjust_tt(valid_trips(with_times(in_bbox(drop_missing(df), bbox), date), max_tt_s))
    keep = (*keep, date) if date is not None else keep
    return trips.withColumns({"card": F.substring("card", 1, 12), "line_raw": F.col("o_line").cast("string")}).select(*CANONICAL, *(F.col(c).cast(t).alias(c) for c, t in CARRIED.items() if c in df.columns), *keep)


def funnel(df: DataFrame, bbox=BBOX, max_tt_s: float = 10800) -> DataFrame:
    """rows_read, in_bbox, valid_time and kept in one pass."""
    there = F.lit(True)
    for c in NEEDED:
        there = there & F.col(c).isNotNull()
    read = lambda c: F.unix_timestamp(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")))
    marked = df.withColumn("tt_s", (read("arr") - read("dep")).cast("double")).withColumns({"_in": F.coalesce(there & inside(bbox), F.lit(False))})
    marked = marked.withColumn("_ok", F.col("_in") & F.coalesce(valid(max_tt_s), F.lit(False)))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return marked.agg(F.count("*").alias("rows_read"), n("_in").alias("in_bbox"), n("_ok").alias("valid_time"), n("_ok").alias("kept"))
