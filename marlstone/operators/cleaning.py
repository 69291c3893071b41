"""Prices as they come: names, types, gaps, the point in time, and how old they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NoData, StaleData

#: Names that a date column may come under.
DATE_NAMES = ("Date", "index", "Datetime", "date")
STALE_DAYS = 10


def rename_date(df: DataFrame, to: str = "Date") -> DataFrame:
    """The first column with one of the usual names gets the name ``to``."""
    if to in df.columns:
        return df
    found = next((c for c in DATE_NAMES if c in df.columns), None)
    return df.withColumnRenamed(found, to) if found else df


def locate_dates(df: DataFrame) -> str | None:
    """The column that holds the dates: one of the usual names, else the first of a date type, else the first text that can be read as dates."""
    named = next((c for c in DATE_NAMES if c in df.columns), None)
    typed = next((f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")), None)
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if named or typed or not texts:
        return named or typed
    some = df.agg(*(F.count(F.col(c).try_cast("date")).alias(c) for c in texts)).first()
    return next((c for c in texts if some[c]), None)


def coerce(df: DataFrame, date: str = "date", close: str = "close", numbers: tuple[str, ...] = ("open", "high", "low", "volume")) -> DataFrame:
    """Dates and numbers by type; rows whose date or close is none are dropped, other numbers become null."""
    out = df.withColumn(date, F.col(date).try_cast("date"))
    for c in (close, *numbers):
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.dropna(subset=[date, close])


def as_of(df: DataFrame, date, column: str = "date") -> DataFrame:
    """Rows that were known at the date. The bound is a literal, so it reaches the scan."""
    return df.where(F.col(column) <= F.lit(date).cast("date"))


def between(df: DataFrame, start, end, column: str = "date") -> DataFrame:
    """Both ends included."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return df.where(F.col(column).between(a.cast("date"), b.cast("date")))


def history(df: DataFrame, date, years: int = 5, today=None, column: str = "date") -> DataFrame:
    """Rows known at the date, from so many years before today on (today: the date itself, unless given). Both bounds reach the scan."""
    return between(df, F.add_months(F.lit(today or date).cast("date"), -12 * years), date, column)


def require_rows(df: DataFrame, symbol: str, detail: str = "no rows") -> DataFrame:
    """The rows; none are a typed answer of its own."""
    if df.isEmpty():
        raise NoData(symbol, detail=detail)
    return df


def require_fresh(df: DataFrame, date, symbol: str, most: int = STALE_DAYS, column: str = "date") -> DataFrame:
    """The rows, unless the newest is more than ``most`` days older than the date. No rows are left to the caller."""
    row = df.agg(F.max(column).alias("last"), F.datediff(F.lit(date).cast("date"), F.max(column)).alias("days")).first()
    if row["days"] is not None and row["days"] > most:
        raise StaleData(symbol, detail=f"the newest row is of {row['last']}, {row['days']} days before {date}")
    return df


def fill_gaps(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """The last value before, else the first one after. Cut to the point in time first: filling back reads later rows."""
    w = W.partitionBy(*by).orderBy(order)
    # Where nothing is before, the first value after is the first of all: a frame that starts anew at each row would take quadratic time.
    before, every = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(every)) for c in columns})


def round_prices(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close"), places: int = 2) -> DataFrame:
    """Half to even, as the numeric libraries do."""
    return df.withColumns({c: F.bround(c, places) for c in columns})


def staleness(df: DataFrame, date, by: tuple[str, ...] = ("symbol",), most: int = STALE_DAYS) -> DataFrame:
    """last_date, days_old and stale for each symbol; ``most`` days are still fresh."""
    out = df.groupBy(*by).agg(F.max("date").alias("last_date"))
    out = out.withColumn("days_old", F.datediff(F.lit(date).cast("date"), F.col("last_date")))
    return out.withColumn("stale", F.col("days_old") > most)


def latest(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """The newest row of each symbol, by one aggregate (no sort of the series)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def last_rows(df: DataFrame, n: int, by: tuple[str, ...] = ("symbol",), order: str = "date", least: int = 1, most: int = 30) -> DataFrame:
    """The newest n rows of each symbol, n held to the bounds."""
    n = max(least, min(n, most))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
