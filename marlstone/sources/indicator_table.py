"""Indicators kept up to date: a new day costs that day, a late correction the days from its date on.

For each symbol a carry says what later rows need: the newest RECENT bars (for rolling windows) and the weighted sums of the exponential means with the
number of rows so far. An update reads the carry and the new bars only, writes the days' rows and the next carry, and
becomes visible with one commit. The carry of each update stays, so that a correction can start from the last one before its date.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import indicators
from .commits import Commits

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
_FIELDS = ("date", "open", "high", "low", "close", "volume")
#: The longest window of the indicators.
RECENT = 200
#: Exponential means that are carried on, by the names that the indicators give them.
_SUMS = ("close_10_ema", "_fast", "_slow", "macds", "_up", "_down", "atr")
_CARRY = "symbol string, rows bigint, recent array<struct<date:date,open:double,high:double,low:double,close:double,volume:double>>, " + ", ".join(f"{n} double" for n in _SUMS)
NAMES = indicators.NAMES
SCHEMA = BARS + ", " + ", ".join(f"{n} double" for n in NAMES)


class _Carried:
    """How the functions of :mod:`indicators` go on after a carry: rows with ``_new`` follow those without, columns ``_c_<name>`` and ``_rows`` are the carry's."""

    @staticmethod
    def previous(df: DataFrame, columns: dict[str, str], by=("symbol",), order="date") -> DataFrame:
        return indicators.previous(df, columns, by, order)

    @staticmethod
    def ewm(df: DataFrame, sources: dict[str, tuple[str, float]], by=("symbol",), order="date") -> DataFrame:
        df = indicators.weighted_sums(df, sources, (*by, "_new"), order)
        place = F.col("_n").cast("double")
        total = {f"_t_{n}": F.col(f"_s_{n}") + F.pow(F.lit(1 - a), place) * F.coalesce(f"_c_{n}", F.lit(0.0)) for n, (_, a) in sources.items()}
        df = df.withColumns(total)
        means = {n: F.when(F.col("_new"), F.col(f"_t_{n}") * a / (1 - F.pow(F.lit(1 - a), place + F.coalesce("_rows", F.lit(0))))) for n, (_, a) in sources.items()}
        return df.withColumns(means).drop("_n", *(f"_s_{n}" for n in sources))


class IndicatorTable:
    """The table at ``path``: SCHEMA, a row for each bar."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, Commits(spark, path)
        if self.commits.newest() is None:
            self.commits.commit({"number": 0, "days": {}, "carries": {}})

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The rows, or those of the dates from first to last; other days aren't opened."""
        days = self.commits.read()["days"]
        return self._rows([f"{folder}/_day={d}" for d, folder in days.items() if (first is None or d >= first) and (last is None or d <= last)])

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def update(self, bars: DataFrame) -> list[str]:
        """Adds or replaces bars (one for each symbol and date; without a close they are left out); returns the days that were written.

        Bars after all that are there cost their own days. Others are corrections: the table is computed anew from the day of the
        earliest on, with the bars that are kept.
        """
        m = self.commits.read()
        kinds = self.spark.createDataFrame([], BARS).schema
        bars = bars.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds)).where("symbol IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")
        span = bars.agg(F.min("date"), F.max("date")).first()
        if span[0] is None:
            return []
        first = span[0].isoformat()
        start = max((d for d in m["carries"] if d < first), default=None)
        kept = [f"{folder}/_day={d}" for d, folder in m["days"].items() if start is None or d > start]
        if kept:
            known = self._rows(kept).select(*(f.name for f in kinds))
            bars = known.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(bars)
        carry = self.spark.read.schema(_CARRY).parquet(f"{self.path}/{m['carries'][start]}") if start else self.spark.createDataFrame([], _CARRY)
        folder = f"data/{m['number'] + 1:012d}-{uuid.uuid4().hex}"
        rows = self._computed(carry, bars).drop("_day")
        wide = rows.where("_new").select(*(f.split()[0] for f in SCHEMA.split(", ")), *(f"_t_{n}" for n in _SUMS), F.date_format("date", "yyyy-MM-dd").alias("_day"))
        wide.repartition("_day").write.partitionBy("_day").parquet(f"{self.path}/{folder}/rows")
        written = self.spark.read.schema(SCHEMA + ", " + ", ".join(f"_t_{n} double" for n in _SUMS)).parquet(f"{self.path}/{folder}/rows")
        self._next_carry(carry, written).write.parquet(f"{self.path}/{folder}/carry")
        days = [d.isoformat() if isinstance(d, dt.date) else d for (d,) in written.select("date").distinct().collect()]
        kept_days = {d: f for d, f in m["days"].items() if start is not None and d <= start}
        carries = {d: f for d, f in m["carries"].items() if d < first}
        self.commits.commit({"number": m["number"] + 1, "days": kept_days | {d: f"{folder}/rows" for d in days}, "carries": carries | {max(days): f"{folder}/carry"}})
        return sorted(days)

    def _computed(self, carry: DataFrame, bars: DataFrame) -> DataFrame:
        """The carried bars and the new ones with all indicators, sums so far among them; only symbols with new bars."""
        symbols = bars.select("symbol").distinct()
        mine = carry.join(symbols, "symbol", "left_semi")
        old = mine.select("symbol", F.inline("recent")).select("symbol", *_FIELDS, F.lit(False).alias("_new"))
        rows = old.unionByName(bars.withColumn("_new", F.lit(True)))
        rows = rows.join(mine.select("symbol", F.col("rows").alias("_rows"), *(F.col(n).alias(f"_c_{n}") for n in _SUMS)), "symbol", "left")
        rows = rows.withColumns({"close_50_sma": indicators.sma("close", 50), "close_200_sma": indicators.sma("close", 200), "vwma": indicators.vwma()})
        rows = indicators.mfi(indicators.bollinger(rows))
        rows = indicators.ema(rows, 10, over=_Carried)
        rows = indicators.macd(rows, over=_Carried)
        return indicators.atr(indicators.rsi(rows, over=_Carried), over=_Carried)

    def _next_carry(self, carry: DataFrame, written: DataFrame) -> DataFrame:
        """The carry after the rows: newest bars and sums of the symbols that have new ones, the others as they were."""
        bars = written.select("symbol", F.struct(*_FIELDS).alias("_b"))
        many = bars.unionByName(carry.select("symbol", F.explode("recent").alias("_b")))
        newest = many.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("_b.date").desc()))).where(F.col("_k") <= RECENT)
        recent = newest.groupBy("symbol").agg(F.array_sort(F.collect_list("_b")).alias("recent"))  # at most RECENT of each
        last = written.groupBy("symbol").agg(F.count(F.lit(1)).alias("_more"), F.max_by(F.struct(*(F.col(f"_t_{n}").alias(n) for n in _SUMS)), "date").alias("_s"))
        out = recent.join(last, "symbol", "left").join(carry.drop("recent"), "symbol", "left")
        sums = (F.when(F.col("_s").isNotNull(), F.col(f"_s.{n}")).otherwise(F.col(n)).alias(n) for n in _SUMS)
        return out.select("symbol", (F.coalesce("rows", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("rows"), "recent", *sums)

    def vacuum(self) -> None:
        """Deletes what no day and no carry is in. Not while others read or write."""
        m = self.commits.read()
        self.commits.vacuum({f.split("/")[1] for f in (*m["days"].values(), *m["carries"].values())})
