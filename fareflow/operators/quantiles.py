"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], width: float | Column = 1.0, weight: str | None = None) -> DataFrame:
    """keys, share, value: between two rows' values as F.percentile gives it; nulls are left out.

    With `weight`, a column of whole numbers, a row counts as so many; rows of null, 0 or less are left out.
    `percentile` keeps a counter for each distinct value of a group in one task. Here equal values are counted first, on both sides of
    one shuffle; their counts by bins of `width`, which have a bounded number for bounded values, tell which bins hold the wanted ranks, and
    only the values of those are put in order.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    x = F.col(value).cast("double")
    kept = rows.where(F.col(value).isNotNull() & (times > 0))
    met = kept.select(*keys, x.alias("_x"), times.alias("_w"), F.floor(x / width).alias("_bin")).groupBy(*keys, "_bin", "_x").agg(F.sum("_w").alias("_n"))
    counts = met.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    # as many rows as a group has bins; without keys, the bins of all rows
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    upto = counts.select("*", F.sum("_n").over(group.orderBy("_bin")).alias("_to"), F.sum("_n").over(group).alias("_all"))
    place = F.col("share") * (F.col("_all") - 1)
    asked = upto.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumns({"_low": F.floor(place), "_part": place - F.floor(place)})
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("_part") > 0, 1).otherwise(0))).alias("_up")).withColumn("_rank", F.col("_low") + F.col("_up"))
    asked = asked.where((F.col("_rank") >= F.col("_to") - F.col("_n")) & (F.col("_rank") < F.col("_to")))
    asked = asked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_b"), "share", "_part", "_up", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_bin") == F.col("_b"))
    bins = asked.select(*[f"_{k}" for k in keys], "_b").distinct()
    within = Window.partitionBy(*keys, "_bin").orderBy("_x")
    ranked = met.join(bins, same, "left_semi").withColumn("_to", F.sum("_n").over(within))
    found = ranked.join(asked, same).where((F.col("_rank") >= F.col("_to") - F.col("_n")) & (F.col("_rank") < F.col("_to")))
    part = F.when(F.col("_up") == 1, F.col("_part")).otherwise(1 - F.col("_part"))
    return found.groupBy(*keys, "share").agg(F.sum(F.col("_x") * part).alias(value))


def quantile_columns(rows: DataFrame, keys: list[str], wanted: dict[str, dict[float, str]], width: float = 1.0, weight: str | None = None) -> DataFrame:
    """keys and, for each column and share in `wanted`, the quantile by the name given there. All columns and groups go through one pass.

    A group without any value has no row; a column without values is null.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_v")) for c in wanted])).alias("_e")
    times = [] if weight is None else [F.col(weight).alias("_times")]
    long = rows.select(*keys, *times, each).select(*keys, *(["_times"] if times else []), "_e.*")
    found = quantiles(long, [*keys, "_of"], "_v", tuple(sorted({q for at in wanted.values() for q in at})), width, "_times" if times else None)
    return found.groupBy(*keys).agg(*[F.max(F.when((F.col("_of") == c) & (F.col("share") == q), F.col("_v"))).alias(name) for c, at in wanted.items() for q, name in at.items()])
