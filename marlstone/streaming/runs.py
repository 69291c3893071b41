"""Streams of run snapshots and ticks.

The windowed aggregates are an extension: the engine's own needs are the keyed states.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dedup_messages(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def last_state(stream: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The newest value of each key so far (for update or complete mode)."""
    return stream.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def windowed_bars(ticks: DataFrame, by: str, time: str, value: str, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Bars of event-time windows; ticks later than the watermark are left out."""
    ticks = ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = ticks.groupBy(window, by).agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    ticks = ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = ticks.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """State on disk, as lists, maps and timers by key need it, for queries that are started inside; partitions: into how many the state is dealt, fixed by the first start."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    wanted |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts writing what is there to a Parquet table and stops when it is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, write, checkpoint: str):
    """Starts giving what is there to ``write(rows, batch)``, one batch after another; a batch may come again after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
