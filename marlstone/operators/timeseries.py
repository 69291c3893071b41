"""Series against calendars, other series and later rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar_dense(values: DataFrame, value: str, end, days: int, by: tuple[str, ...] = ("symbol",), date: str = "date") -> DataFrame:
    """Every calendar day of the look-back for every symbol: date, value, status (ok, warmup where the value is null, non_trading)."""
    end = F.lit(end).cast("date")
    keys = values.select(*by).distinct()
    every = keys.withColumn(date, F.explode(F.sequence(F.date_sub(end, days), end)))
    rows = values.select(*by, date, value, F.lit(True).alias("_there"))
    out = every.join(rows, [*by, date], "left")
    status = F.when(F.col("_there").isNull(), "non_trading").when(F.col(value).isNull(), "warmup").otherwise("ok")
    return out.select(*by, date, value, status.alias("status"))


def as_of_rows(left: DataFrame, right: DataFrame, by: tuple[str, ...], date: str) -> DataFrame:
    """The rows of both sides in one frame, as structs ``_l`` and ``_r``; ``_kind`` puts right rows of a date first."""
    theirs = [c for c in right.columns if c not in (*by, date)]
    mine = [c for c in left.columns if c not in (*by, date)]
    packed = F.struct(F.col(date).alias(date), *theirs)
    a = left.select(*by, date, F.struct(*(mine or [date])).alias("_l"), F.lit(1).alias("_kind")).withColumn("_r", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType))
    b = right.select(*by, date, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_kind"), packed.alias("_r"))
    return a.unionByName(b)


def as_of_result(rows: DataFrame, left: DataFrame, right: DataFrame, by: tuple[str, ...], date: str, prefix: str) -> DataFrame:
    """The left rows with the columns of ``_r``."""
    theirs = [c for c in right.columns if c not in (*by, date)]
    mine = [c for c in left.columns if c not in (*by, date)]
    return rows.where("_kind = 1").select(*by, date, *(F.col(f"_l.{c}").alias(c) for c in mine), *(F.col(f"_r.{c}").alias(prefix + c) for c in (date, *theirs)))


def as_of_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("symbol",), date: str = "date", prefix: str = "asof_") -> DataFrame:
    """For each left row the newest right row on or before its date, by a union and one window (no row blow-up).

    Several right rows at one date must not be: reduce them first. Left rows without one get nulls. For series of very many rows
    there is :func:`scan.as_of_join`.
    """
    w = W.partitionBy(*by).orderBy(date, "_kind").rowsBetween(W.unboundedPreceding, 0)
    rows = as_of_rows(left, right, by, date).withColumn("_r", F.last("_r", True).over(w))
    return as_of_result(rows, left, right, by, date, prefix)


def forward_return(df: DataFrame, k: int, value: str = "close", name: str = "fwd_return", by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """The simple return over the next k rows; null where there are fewer."""
    later = F.lead(value, k).over(W.partitionBy(*by).orderBy(order))
    return df.withColumn(name, F.try_divide(later - F.col(value), F.col(value)))


def holding_outcome(decisions: DataFrame, bars: DataFrame, benchmark: DataFrame, rows: int = 5, buffer: int = 7) -> DataFrame:
    """raw, alpha and days of every decision (symbol, date): returns over k rows by position in each series.

    k is the holding period, or less if either series has fewer rows in the window of
    ``rows + buffer`` calendar days from the decision; with fewer than two rows in either all three
    are null. The benchmark (date, close) is taken by its own rows, not by the asset's dates.
    alpha is the difference of the returns.
    """
    decisions = decisions.withColumn("_d", F.col("date"))
    keys = decisions.select("symbol", "_d").distinct()
    window = F.explode(F.sequence("_d", F.date_add("_d", rows + buffer - 1))).alias("_date")

    def path(starts: DataFrame, prices: DataFrame, on: list[str], name: str) -> DataFrame:
        """The closes of the window of each start: its days are listed, so the join is on equal dates."""
        joined = starts.select("*", window).join(prices, [*on, "_date"])
        return joined.groupBy(*on, "_d").agg(F.array_sort(F.collect_list(F.struct("_date", "close"))).alias(name))

    assets = path(keys, bars.select("symbol", F.col("date").alias("_date"), "close"), ["symbol"], "_a")
    bench = path(keys.select("_d").distinct(), benchmark.select(F.col("date").alias("_date"), "close"), [], "_b")
    out = decisions.join(assets, ["symbol", "_d"], "left").join(bench, "_d", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size_a, size_b = F.when(F.col("_a").isNull(), 0).otherwise(n("_a")), F.when(F.col("_b").isNull(), 0).otherwise(n("_b"))
    out = out.withColumn("days", F.when((size_a >= 2) & (size_b >= 2), F.least(F.lit(rows), size_a - 1, size_b - 1)))
    gain = lambda c: (F.get(c, F.col("days"))["close"] - F.get(c, F.lit(0))["close"]) / F.get(c, F.lit(0))["close"]
    out = out.withColumn("raw", F.when(F.col("days").isNotNull(), gain(F.col("_a")))).withColumn("alpha", F.col("raw") - F.when(F.col("days").isNotNull(), gain(F.col("_b"))))
    return out.drop("_d", "_a", "_b")


def change_over_window(points: DataFrame, by: tuple[str, ...] = ("series",), date: str = "date", value: str = "value") -> DataFrame:
    """n, first and last value with their dates, delta and pct (null where the first value is 0) of the points that have a value."""
    some = points.where(F.col(value).isNotNull())
    out = some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.min_by(value, date).alias("first_value"), F.max(date).alias("last_date"), F.max_by(value, date).alias("last_value")
    )
    out = out.withColumn("delta", F.col("last_value") - F.col("first_value"))
    return out.withColumn("pct", 100 * F.try_divide(F.col("delta"), F.col("first_value")))


def recent(df: DataFrame, n: int, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first n rows of each group in the order given."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
