"""Route choice over a table of options (od, rnk and cost components)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generalized_cost(df: DataFrame, beta_ivt=1.0, beta_wait=1.5, beta_walk=1.5, beta_transfer=300.0) -> DataFrame:
    cost = beta_ivt * F.col("in_vehicle_time") + beta_wait * F.col("expected_wait") + beta_walk * F.col("walk_time") + beta_transfer * F.col("num_transfers")
    return df.withColumn("cost", cost)


def logit(df: DataFrame, theta: float = 0.005) -> DataFrame:
    """prob: the softmax of -theta cost among an od's options."""
    od = Window.partitionBy("od")
    weight = F.exp(-theta * (F.col("cost") - F.min("cost").over(od)))
    return df.withColumn("_w", weight).withColumn("prob", F.col("_w") / F.sum("_w").over(od)).drop("_w")


def shortest_choice(df: DataFrame) -> DataFrame:
    """Each od's first option of least cost, with probability 1."""
    first = Window.partitionBy("od").orderBy("cost", "rnk")
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("prob", F.lit(1.0))


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from a row's keys, the same wherever the row is."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def assign(trips: DataFrame, options: DataFrame, u: Column, override: Column | None = None) -> DataFrame:
    """trips (od) with the rnk of their route: the first whose cumulated probability reaches u; null without options.

    Where override is not null, it is the choice.
    """
    ladder = options.groupBy("od").agg(F.array_sort(F.collect_list(F.struct("rnk", "prob"))).alias("_o"))
    joined = trips.join(ladder, "od", "left").withColumn("_u", u)
    steps = F.transform("_o", lambda x, i: F.struct(x["rnk"].alias("rnk"), F.aggregate(F.slice("_o", 1, i + 1), F.lit(0.0), lambda a, y: a + y["prob"]).alias("cum")))
    reached = F.get(F.filter(steps, lambda x: x["cum"] >= F.col("_u")), F.lit(0))["rnk"]
    drawn = F.coalesce(reached, F.element_at("_o", -1)["rnk"])  # rounding can leave the last sum just below 1
    chosen = drawn if override is None else F.coalesce(override, drawn)
    return joined.withColumn("chosen", F.when(F.col("_o").isNotNull(), chosen)).drop("_o", "_u")
