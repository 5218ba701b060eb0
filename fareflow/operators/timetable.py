"""Timetables: departures, stop times, and the next vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def departures(lines: DataFrame, headways: DataFrame, service: tuple[float, float] = (18000.0, 84600.0), step: float = 10.0) -> DataFrame:
    """(line, k, t): from the start of service, each departure a headway of its hour after the one before.

    Times are rounded up to the step. Inside an hour the headway is one, so its departures are an arithmetic sequence; a fold over
    the hours carries the next one on. A headway below the step, 0 or less counts as the step. An hour without a headway takes that of the
    hour before in the service, else the one of the line's first hour; a line without any has no departures.
    """
    start, end = service
    known = headways.where("headway_s is not null").join(lines.select("line").distinct(), "line", "left_semi").groupBy("line", F.col("hour").cast("int").alias("hour")).agg(F.max(F.col("headway_s").cast("double")).alias("h"))
    by_line = known.groupBy("line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "h")))).alias("h"))
    grid = lambda x: F.ceil(x / step) * step

    def hour(state: Column, number: Column) -> Column:
        border, t = F.least((number + 1) * 3600.0, F.lit(end)), state["t"]
        headway = F.coalesce(F.col("h")[F.pmod(number, F.lit(24)).cast("int")], state["headway"])
        gap = F.greatest(grid(headway), F.lit(step))
        second = F.greatest(grid(t + headway), (F.floor(t / step) + 1) * step)
        more = F.greatest(F.ceil((border - second) / gap), F.lit(0)).cast("int")
        on = F.when(more > 0, F.transform(F.sequence(F.lit(0), more - 1), lambda i: (second + i * gap).cast("double"))).otherwise(F.array().cast("array<double>"))
        goes = t < border
        return F.struct(
            F.when(goes, second + more * gap).otherwise(t).cast("double").alias("t"), headway.alias("headway"),
            F.when(goes, F.concat(state["out"], F.array(t), on)).otherwise(state["out"]).alias("out"))

    hours = F.array(*[F.lit(h) for h in range(int(start // 3600), int(-(-end // 3600)))])
    first = F.struct(F.lit(float(start)).alias("t"), F.map_values("h")[0].alias("headway"), F.array().cast("array<double>").alias("out"))
    folded = by_line.select("line", F.aggregate(hours, first, hour)["out"].alias("out"))
    return folded.select("line", F.posexplode("out").alias("k", "t"))


def stop_times(trips: DataFrame, segments: DataFrame) -> DataFrame:
    """(line, k, pos, node, arrive): each departure at each stop, by the values of the period of its departure.

    segments: line, period, pos, node, time (null at the first), dwell_s, terminal_hold_s.
    """
    own = Window.partitionBy("line", "period").orderBy("pos")
    before = F.sum(F.coalesce("time", F.lit(0.0)) + F.when(F.col("pos") > 1, F.col("dwell_s")).otherwise(0.0)).over(own)
    offsets = segments.withColumn("offset", before + F.when(F.col("pos") > 0, F.col("terminal_hold_s")).otherwise(0.0)).select("line", "period", "pos", "node", "offset")
    return trips.join(offsets, ["line", "period"]).select("line", "k", "pos", "node", (F.col("t") + F.col("offset")).alias("arrive"))


def next_vehicle(ready: DataFrame, times: DataFrame, max_wait_s: float = 1500) -> DataFrame:
    """ready (id, node, line, ready) with vehicle, the first arrival then or later, wait, and timed_out.

    One sort of both sides by stop and line, and hour: a request looks in its own hour's rows first, and
    each hour also holds the first arrival of any later hour, so hot stops are split by hours.
    """
    hour = lambda c: F.floor(F.col(c) / 3600)
    keys = ["node", "line"]
    first = times.groupBy(*keys, hour("arrive").alias("h")).agg(F.min("arrive").alias("a"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
    hours = first.unionByName(ready.select(*keys, hour("ready").alias("h"), F.lit(None).cast("double").alias("a"))).groupBy(*keys, "h").agg(F.min("a").alias("a"))
    later = hours.select(*keys, "h", F.min("a").over(ahead).alias("arrive")).where("arrive is not null")
    empty = F.lit(None).cast("long")
    rows = times.select(*keys, hour("arrive").alias("h"), F.col("arrive").alias("at"), "arrive", empty.alias("id"))
    rows = rows.unionByName(later.select(*keys, "h", F.lit(float("inf")).alias("at"), "arrive", empty.alias("id")))
    rows = rows.unionByName(ready.select(*keys, hour("ready").alias("h"), F.col("ready").alias("at"), F.lit(None).cast("double").alias("arrive"), F.col("id").cast("long").alias("id")))
    # from the latest row back: a frame that grows takes one step a row, one that shrinks is read anew for each
    back = Window.partitionBy(*keys, "h").orderBy(F.desc("at"), F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("vehicle", F.last("arrive", ignorenulls=True).over(back)).where("id is not null")
    wait = F.col("vehicle") - F.col("at")
    return found.select("id", *keys, F.col("at").alias("ready"), "vehicle", wait.alias("wait"), F.coalesce(wait > max_wait_s, F.lit(True)).alias("timed_out"))
