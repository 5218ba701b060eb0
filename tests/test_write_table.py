"""Writing of partitioned tables."""

from pyspark.sql import functions as F

from fareflow.sources import tables


def test_partitioned_rows_are_not_sorted(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    rows = spark.range(1000).withColumn("mode", F.when(F.col("id") % 2 == 0, "bus").otherwise("subway"))
    tables.write_table(rows, f"{tmp_path}/t", ["mode"])
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())]
    mine = [p for p in plans if f"{tmp_path}/t" in p]
    assert mine and not any("Sort" in p for p in mine)
    assert spark.conf.get(name, None) is None
    got = spark.read.parquet(f"{tmp_path}/t")
    assert {r["mode"]: r["count"] for r in got.groupBy("mode").count().collect()} == {"bus": 500, "subway": 500}
    # more partitions than open files
    tables.write_table(rows.withColumn("k", F.col("id") % 100), f"{tmp_path}/u", ["k"])
    assert spark.read.parquet(f"{tmp_path}/u").count() == 1000
