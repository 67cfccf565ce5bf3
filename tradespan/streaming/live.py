"""Live bars: ticks or short bars aggregated as they arrive, with late data within the delay.

Watermarks need a TIMESTAMP, so times are cast at the edge of the stream (the
session's zone must be UTC) and cast back on output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.functions.bars import upserted


def live_bars(ticks: DataFrame, minutes: int, delay_minutes: int = 15, margin_minutes: int = 10, offset_minutes: int = 0) -> DataFrame:
    """Bars of ``minutes`` from a stream of (symbol, ts, seq, price, size).

    Windows start at ``offset_minutes`` past the epoch's. A tick later than the
    delay plus the margin is dropped; in append mode a bar comes out once no
    more ticks can change it, in update mode whenever it changes.
    """
    stream = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{delay_minutes + margin_minutes} minutes")
    length = f"{minutes} minutes"
    window = F.window("ts", length, length, f"{offset_minutes} minutes") if offset_minutes else F.window("ts", length)
    key = F.struct("ts", "seq")
    made = stream.groupBy("symbol", window.alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume")
    )
    return made.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_left"), F.col("w.end").cast("timestamp_ntz").alias("bar_right"), "open", "high", "low", "close", "volume")


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps one row per (symbol, bar_left) in a parquet table by day.

    A batch rewrites only the days it touches: their new rows are laid beside
    the table first, then put in their place, so nothing is read from where it
    is written, and a batch that runs twice gives the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("day", F.to_date("bar_left"))
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        held = jvm.Path(f"{path}/bars")
        if held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held):
            table = spark.read.schema(fresh.schema).parquet(f"{path}/bars")
            days = fresh.select("day").distinct()
            touched = table.join(days, "day", "left_semi")
            fresh = upserted(touched, fresh.select(*touched.columns))
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/next")
        made = spark.read.schema(fresh.schema).parquet(f"{path}/next")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/bars")

    return write


def live_table(spark, path: str) -> DataFrame:
    """The table that ``upsert_sink`` keeps."""
    return spark.read.parquet(f"{path}/bars").drop("day")
