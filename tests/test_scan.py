"""Scans of series in parts, against the windows over whole series."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import cleaning, indicators, scan, timeseries

SCHEMA = "symbol string, date date, high double, low double, close double, open double"


def bars(spark, n=700, seed=1):
    """A long series, one without a name, a short one, one of one row; close is null nowhere, open often."""
    r = random.Random(seed)
    rows = []
    for symbol, size in (("long", n), (None, 40), ("short", 9), ("one", 1)):
        for i in range(size):
            x = 100 + 20 * math.sin(i / 7) + r.random()
            rows.append((symbol, dt.date(2000, 1, 1) + dt.timedelta(i * (1 if i < n // 2 else 3)), x + 1, x - 1, x, x if r.random() < 0.2 and not 20 < i < 300 else None))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b, columns, digits=7):
    key = lambda df: sorted(((r["symbol"] or "", r["date"]), *(None if r[c] is None else round(r[c], digits) if isinstance(r[c], float) else r[c] for c in columns)) for r in df.select("symbol", "date", *columns).collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("rows", [7, 64, 10**6])
def test_like_windows(spark, rows):
    df = bars(spark)
    parts = scan.cut(df, rows=rows)
    same(indicators.ema(parts, 10, over=scan), indicators.ema(df, 10), ["close_10_ema"])
    same(indicators.macd(parts, over=scan), indicators.macd(df), ["macd", "macds", "macdh"])
    same(indicators.rsi(parts, over=scan), indicators.rsi(df), ["rsi"])
    same(indicators.atr(parts, over=scan), indicators.atr(df), ["atr"])
    same(indicators.ewm(df, {"slow": ("close", 2 / 201)}), scan.ewm(parts, {"slow": ("close", 2 / 201)}), ["slow"])
    same(scan.fill_gaps(parts, ("open",)), cleaning.fill_gaps(df, ("open",)), ["open"])
    right = df.where("open IS NOT NULL").select("symbol", "date", "close", "high")
    left = df.select("symbol", "date", "low")
    same(scan.as_of_join(left, right, rows=rows), timeseries.as_of_join(left, right), ["low", "asof_date", "asof_close", "asof_high"])


def test_parts_are_even_and_in_order(spark):
    """A series of nearly all rows, with a burst of equal dates far from the rest: no part has over an eighth, equal places share one."""
    df = spark.range(8000).select(F.lit("a").alias("symbol"), F.when(F.col("id") < 100, F.col("id") - 10**9).otherwise(F.expr("id div 2")).alias("date"), F.col("id").cast("double").alias("close"))
    parts = scan.cut(df, rows=250)
    sizes = [r["n"] for r in parts.groupBy(scan.PART).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 30 and max(sizes) <= 1000
    assert parts.groupBy("date").agg(F.count_distinct(scan.PART).alias("k")).where("k > 1").isEmpty()
    ends = parts.groupBy(scan.PART).agg(F.min("date").alias("low"), F.max("date").alias("high")).orderBy(scan.PART).collect()
    assert all(a["high"] < b["low"] for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_times_and_empty(spark):
    df = spark.range(300).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("date"), F.col("id").cast("double").alias("close"))
    assert scan.cut(df, rows=50).select(scan.PART).distinct().count() >= 5
    assert scan.ewm(scan.cut(df.limit(0)), {"e": ("close", 0.5)}).count() == 0


def test_no_task_reads_a_whole_series(spark):
    """The shuffle is by series and part, and what parts hand on is sent to all tasks."""
    plan = indicators.rsi(scan.cut(bars(spark), rows=64), over=scan)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("fill", [cleaning.fill_gaps, lambda df, columns: scan.fill_gaps(scan.cut(df, rows=64), columns)])
def test_filling_is_linear(spark, fill):
    """No frame runs from each row to the end of its series, which would be read anew for every row."""
    plan = fill(bars(spark), ("open",))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan and "unboundedpreceding$(), unboundedfollowing$()" in plan
    assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan


def test_weighted_sums_are_computed_once(spark):
    """What is read twice is read from a table: no window over rows is left in the plan, which each of the two readers would run again."""
    plan = scan.ewm(scan.cut(bars(spark), rows=64), {"e": ("close", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan
