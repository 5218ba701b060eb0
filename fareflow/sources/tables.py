"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TAPS = (
    "card string, o_mode string, o_line string, o_dir smallint, o_stopno smallint, o_name string, o_lon double, o_lat double, dep string, "
    "d_mode string, d_line string, d_dir smallint, d_stopno smallint, d_name string, d_lon double, d_lat double, arr string"
)
SPEEDS = "scope string, key string, period string, speed_kmh double, dwell_s double, stop_delay_s double, terminal_hold_s double, n_obs bigint"
HEADWAYS = "scope string, key string, hour string, headway_s double, n_obs bigint, method string"
TRANSFERS = "scope string, key string, transfer_time_s double, n_obs bigint, raw_median_s double"


def in_file_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """df, just read from files, with the place of each row: its file's name, the block's start, and the place in the block.

    Values are structs that sort as the rows stand; the reader's own order of files plays no part.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(name))


def read_taps(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw journeys from CSV with a header; columns go by position."""
    df = spark.read.schema(RAW_TAPS).option("header", True).option("enforceSchema", True).csv(path)
    return df if limit is None else df.limit(limit)


def read_matched(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with seq, their order: a column of the files, as whole numbers, or else the places of rows in the files."""

    def table(path: str, numbers: tuple[str, ...]) -> DataFrame:
        df = spark.read.option("header", True).csv(path)
        df = df.withColumn("seq", F.col("seq").cast("long")) if "seq" in df.columns else in_file_order(df)
        return df.withColumns({c: F.col(c).cast("double") for c in numbers if c in df.columns})

    return table(nodes, ("x", "y")).where(F.col("node_type").isin("subway", "bus")), table(edges, ("distance", "travel_time"))


def _read(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of each key, in the order of file names and of rows in them; an empty table where there is no file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    df = in_file_order(spark.read.option("header", True).schema(schema).csv(path), "_n")
    if "hour" in df.columns:
        number = F.expr("try_cast(hour as double)")
        df = df.withColumn("hour", F.when(number.isNotNull(), number.cast("int").cast("string")).otherwise("all"))
    rest = [c for c in df.columns if c not in (*keys, "_n")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("x")).select(*keys, "x.*")


def read_speeds(spark, path):
    return _read(spark, path, SPEEDS, ["scope", "key", "period"])


def read_headways(spark, path):
    return _read(spark, path, HEADWAYS, ["scope", "key", "hour"])


def read_transfers(spark, path):
    return _read(spark, path, TRANSFERS, ["scope", "key"])


def read_demand(spark: SparkSession, path: str, time_column: str = "time") -> DataFrame:
    """Demand from CSV; unreadable times are null."""
    df = spark.read.option("header", True).csv(path).withColumnRenamed(time_column, "time")
    return df.withColumn("time", F.expr("try_cast(time as double)"))


#: Files that a task keeps open; one that meets more partitions sorts its other rows first.
OPEN = 32


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """With partitions, rows go to their files as they come: without open files for all, Spark sorts every task's rows, and spills them."""
    writer, conf, name = df.write.mode("overwrite").option("header", True).format(fmt), df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    if not partition_by:
        writer.save(path)
        return
    given = conf.get(name, None)
    conf.set(name, max(OPEN, int(given or 0)))
    try:
        writer.partitionBy(*partition_by).save(path)
    finally:
        conf.unset(name) if given is None else conf.set(name, given)


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
