"""Decisions from pending to resolved, as a stream.

Input rows are of four kinds, each with a symbol and a date: a ``decision``, a ``bar`` of the symbol, a ``bench`` bar of
its benchmark, and a ``clock`` row that only says how far time has come. State is kept for each symbol: the pending decisions, and the bars
since the oldest of them. A decision is resolved once, when the watermark has passed the bar that decides it (the k-th after its first
on both sides) or the end of its window, whichever is first; timers wake the symbol then. So the result doesn't depend on the
order of rows within the watermark, or on how they are split into batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION, BAR, BENCH, CLOCK = "decision", "bar", "bench", "clock"
INPUT = "symbol string, kind string, date date, close double"
RESOLVED = "symbol string, date date, days int, raw double, alpha double"
_DAY = 86_400_000
_EPOCH = dt.date(1970, 1, 1)


def outcome_rows(decisions: DataFrame, bars: DataFrame, benchmark: DataFrame, benchmark_of: DataFrame | None = None) -> DataFrame:
    """The stream's input from decisions (symbol, date), bars (symbol, date, close) and benchmark bars (date, close).

    benchmark_of (symbol, benchmark): the benchmark (a column of the benchmark bars then) of each symbol; without it one
    serves all symbols that have decisions or bars. A benchmark bar goes to each of its symbols, which is as many rows as the symbols' own bars have.
    """
    one = lambda df, kind, close: df.select(F.col("symbol").cast("string").alias("symbol"), F.lit(kind).alias("kind"), F.col("date").cast("date").alias("date"), close.cast("double").alias("close"))
    if benchmark_of is None:
        symbols = decisions.select("symbol").unionByName(bars.select("symbol")).distinct().withColumn("benchmark", F.lit(""))
        fan = benchmark.withColumn("benchmark", F.lit("")).join(symbols, "benchmark")
    else:
        fan = benchmark.join(benchmark_of, "benchmark")
    return one(decisions, DECISION, F.lit(None)).unionByName(one(bars, BAR, F.col("close"))).unionByName(one(fan, BENCH, F.col("close")))


class _Resolver(StatefulProcessor):
    """Days are counted from 1970, so that state and timers are whole numbers."""

    def __init__(self, rows: int, buffer: int):
        self.rows, self.window = rows, rows + buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "day int")
        self.own = handle.getListState("own", "day int, close double")
        self.bench = handle.getListState("bench", "day int, close double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows))
        days = [(d.date() if isinstance(d, dt.datetime) else d).toordinal() - _EPOCH.toordinal() for d in df["date"]]
        pending = sorted({x[0] for x in self.pending.get()} | {d for d, k in zip(days, df["kind"], strict=True) if k == DECISION})
        sides = []
        for state, kind in ((self.own, BAR), (self.bench, BENCH)):
            known = dict(tuple(x) for x in state.get())
            # Of several bars of one date the first stays.
            for d, k, c in zip(days, df["kind"], df["close"], strict=True):
                if k == kind and c == c:
                    known.setdefault(d, float(c))
            sides.append(known)
        yield from self._resolve(key, pending, sides, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._resolve(key, [x[0] for x in self.pending.get()], [dict(tuple(x) for x in s.get()) for s in (self.own, self.bench)], timerValues)

    def _resolve(self, key: tuple, pending: list[int], sides: list[dict[int, float]], times) -> Iterator[pd.DataFrame]:
        """Resolves what is due, keeps the rest, and sets a timer for each time at which something may be due."""
        now = times.getCurrentWatermarkInMs()
        out, left, wake = [], [], set()
        paths = [sorted(s.items()) for s in sides]
        for day in pending:
            inside = [[(d, c) for d, c in p if day <= d < day + self.window] for p in paths]
            full = all(len(x) > self.rows for x in inside)
            due = (max(x[self.rows][0] for x in inside) if full else day + self.window - 1) * _DAY
            if due < now:
                k = min(self.rows, *(len(x) - 1 for x in inside))
                gains = [(x[k][1] - x[0][1]) / x[0][1] if x[0][1] else None for x in inside] if k >= 1 else [None, None]
                alpha = gains[0] - gains[1] if None not in gains else None
                out.append((key[0], _EPOCH + dt.timedelta(day), k if k >= 1 else None, gains[0], alpha))
            else:
                left.append(day)
                wake.add(due + 1)
        # A decision that is still to come is not older than the watermark.
        first = min([*left, now // _DAY])
        for state, values in zip((self.pending, self.own, self.bench), ([(d,) for d in left], *([x for x in p if x[0] >= first] for p in paths)), strict=True):
            if values:
                state.put(values)
            else:
                state.clear()
        for old in list(self.handle.listTimers()):
            if old not in wake:
                self.handle.deleteTimer(old)
        for new in wake:
            self.handle.registerTimer(new)
        if out:
            frame = pd.DataFrame(out, columns=["symbol", "date", "days", "raw", "alpha"])
            yield frame.astype({"days": "Int32", "raw": "Float64", "alpha": "Float64"})


def resolved(stream: DataFrame, rows: int = 5, buffer: int = 7, late: str = "0 seconds") -> DataFrame:
    """symbol, date, days, raw and alpha of each decision of the stream (the columns of INPUT), once it is resolved.

    The meaning is that of :func:`timeseries.holding_outcome`: returns over k rows within ``rows + buffer`` calendar days, all three null
    with fewer than two rows on either side. A decision that is pending already is not taken twice. late: how far rows may be behind the newest
    date; later ones are left out. Rows without a symbol, a date or, for bars, a close are left out. Needs the RocksDB state store.
    """
    known = stream.where("symbol IS NOT NULL AND date IS NOT NULL").withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    return known.groupBy("symbol").transformWithStateInPandas(_Resolver(rows, buffer), RESOLVED, "Append", "EventTime")
