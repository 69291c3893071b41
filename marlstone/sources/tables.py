"""Tables, and the market entities that are made from them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(*parts: tuple[Column, int]) -> Column:
    """Non-negative whole numbers of at most so many digits as one decimal that orders like the row of them (38 digits in all).

    Unlike a struct it fits the buffers of a hash aggregate, so rows need no sort to find the first.
    """
    if sum(digits for _, digits in parts) > 38:
        raise ValueError("more than 38 digits")
    out = None
    for value, digits in parts:
        value = value.cast(f"decimal({digits},0)")
        out = value if out is None else (out * F.lit(Decimal(10**digits)) + value).cast("decimal(38,0)")
    return out.cast("decimal(38,0)")


def daily_bars(ticks: DataFrame, symbol: str, time: str, price: Column, volume: Column, order: Column) -> DataFrame:
    """symbol, date, open, high, low, close, volume from ticks; ``order`` makes first and last of a day unique."""
    rows = ticks.select(F.col(symbol).cast("string").alias("symbol"), F.to_date(time).alias("date"), price.alias("_price"), volume.alias("_volume"), order.alias("_order"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by("_price", "_order").alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"), F.max_by("_price", "_order").alias("close"), F.sum("_volume").cast("double").alias("volume")
    )


def event_bars(spark: SparkSession, folder: str, symbol: str = "event_type") -> DataFrame:
    order = packed((F.unix_micros(F.col("ts").cast("timestamp")), 19), (F.col("event_id"), 19))
    return daily_bars(load(spark, folder, "events"), symbol, "ts", F.col("value"), F.lit(1), order)


def line_bars(spark: SparkSession, folder: str, symbol: str = "l_returnflag") -> DataFrame:
    """Long series: unit price of line items; there is no time of day, so keys order a day's rows."""
    order = packed((F.col("l_orderkey"), 16), (F.col("l_linenumber"), 2), (F.round(F.col("l_extendedprice") * 100), 12), (F.col("l_quantity"), 4))
    return daily_bars(load(spark, folder, "lineitem"), symbol, "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), order)


def line_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """All line items as one series (symbol, tick, high, low, close): tick is the key of an item; prices are those per unit, the lowest after the discount."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = load(spark, folder, "lineitem").groupBy(F.lit("L").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tick"))
    return rows.agg(F.max(price).alias("high"), F.min(price * (1 - F.col("l_discount"))).alias("low"), F.min(price).alias("close"))


def average_bars(bars: DataFrame) -> DataFrame:
    """The average close of all symbols for each date, as a benchmark series."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"))
