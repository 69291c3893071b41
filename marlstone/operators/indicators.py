"""Technical indicators as window expressions, by their conventional definitions.

Rolling ones use partial windows at the start of a series. Exponential ones weigh by
``(1 - alpha) ** age`` and divide by the sum of the weights (so the first value is the first
price). They are computed in linear time without leaving the JVM: prefix sums within blocks
of rows, and the sums of earlier blocks carried over as scalars, so a long series is never
gathered into one list.
"""

from __future__ import annotations

import re
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeseries import calendar_dense

#: Rows of a block: at the slowest decay in use the weights inside stay within a factor of 10**8.
BLOCK = 256


def _series(by: tuple[str, ...], order: str):
    return W.partitionBy(*by).orderBy(order)


def rolling(by: tuple[str, ...], order: str, n: int):
    return _series(by, order).rowsBetween(-(n - 1), 0)


def sma(value: str, n: int, by=("symbol",), order="date") -> Column:
    return F.avg(value).over(rolling(by, order, n))


def bollinger(df: DataFrame, value: str = "close", n: int = 20, width: float = 2.0, by=("symbol",), order="date") -> DataFrame:
    """boll, boll_ub, boll_lb; the bands are null where there is one row."""
    w = rolling(by, order, n)
    middle, spread = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return df.withColumns({"boll": middle, "boll_ub": middle + width * spread, "boll_lb": middle - width * spread})


def vwma(n: int = 14, by=("symbol",), order="date") -> Column:
    """Typical price weighted by volume; null where there was no volume."""
    w = rolling(by, order, n)
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(F.sum(price * F.col("volume")).over(w), F.sum("volume").over(w))


def mfi(df: DataFrame, n: int = 14, by=("symbol",), order="date") -> DataFrame:
    """Money flow index from 0 to 100: the share of the flow on days whose typical price rose; null where nothing flowed."""
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", price).withColumn("_prev", F.lag("_tp").over(_series(by, order)))
    flow = F.col("_tp") * F.col("volume")
    w = rolling(by, order, n)
    up, down = F.sum(F.when(F.col("_tp") > F.col("_prev"), flow).otherwise(0.0)).over(w), F.sum(F.when(F.col("_tp") < F.col("_prev"), flow).otherwise(0.0)).over(w)
    return df.withColumn("mfi", 100 * F.try_divide(up, up + down)).drop("_tp", "_prev")


def weighted_sums(df: DataFrame, sources: dict[str, tuple[str, float]], by=("symbol",), order="date") -> DataFrame:
    """Adds ``_n``, the place in the series, and for each name -> (column, alpha) the sum ``_s_<name>`` of all values so far, each times (1 - alpha) ** age.

    With q = 1 - alpha, a row at place j of its block has the sum P_j = q**j * sum(x_i * q**-i) of
    the block so far, and the weighted sum is P_j + q**(j + 1) * (E_1 + q**BLOCK * E_2 + ...) over
    the block sums E of earlier blocks, which are lags by whole blocks of the last row of the
    block before. Blocks that weigh nothing in double precision are left out. All of it is windows
    over one distribution by series: the input is computed once.
    """
    series = _series(by, order)
    df = df.withColumn("_n", F.row_number().over(series)).withColumn("_block", F.floor((F.col("_n") - 1) / BLOCK)).withColumn("_j", ((F.col("_n") - 1) % BLOCK).cast("double"))
    inside = W.partitionBy(*by, "_block").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    sums = {}
    for name, (column, alpha) in sources.items():
        q = 1 - alpha
        sums[f"_p_{name}"] = F.pow(F.lit(q), F.col("_j")) * F.sum(F.col(column) * F.pow(F.lit(q), -F.col("_j"))).over(inside)
    df = df.withColumns(sums)
    ends = {}
    for name, (_, alpha) in sources.items():
        q, back = (1 - alpha) ** BLOCK, 1
        total = F.col(f"_p_{name}")
        while q**back > 1e-18:
            total = total + q**back * F.coalesce(F.lag(f"_p_{name}", back * BLOCK).over(series), F.lit(0.0))
            back += 1
        ends[f"_e_{name}"] = F.when(F.col("_j") == BLOCK - 1, total)
    df = df.withColumns(ends)
    before = series.rowsBetween(W.unboundedPreceding, -1)
    carried = {f"_s_{n}": F.col(f"_p_{n}") + F.pow(F.lit(1 - alpha), F.col("_j") + 1) * F.coalesce(F.last(f"_e_{n}", True).over(before), F.lit(0.0)) for n, (_, alpha) in sources.items()}
    return df.withColumns(carried).drop("_block", "_j", *(f"_{k}_{n}" for n in sources for k in "pe"))


def ewm(df: DataFrame, sources: dict[str, tuple[str, float]], by=("symbol",), order="date") -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha). Columns must have no nulls."""
    out = {n: F.col(f"_s_{n}") * alpha / (1 - F.pow(F.lit(1 - alpha), F.col("_n").cast("double"))) for n, (_, alpha) in sources.items()}
    return weighted_sums(df, sources, by, order).withColumns(out).drop("_n", *(f"_s_{n}" for n in sources))


def previous(df: DataFrame, columns: dict[str, str], by=("symbol",), order="date") -> DataFrame:
    """Adds the values of the row before: name -> column."""
    return df.withColumns({n: F.lag(c).over(_series(by, order)) for n, c in columns.items()})


def span(n: float) -> float:
    """The alpha of a span."""
    return 2 / (n + 1)


#: How a function goes along a series, by its ``previous`` and ``ewm``: windows of this module, or the module :mod:`scan` for series in parts.
_HERE = sys.modules[__name__]


def ema(df: DataFrame, n: int, value: str = "close", name: str | None = None, by=("symbol",), order="date", over=_HERE) -> DataFrame:
    return over.ewm(df, {name or f"{value}_{n}_ema": (value, span(n))}, by, order)


def macd(df: DataFrame, value: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, by=("symbol",), order="date", over=_HERE) -> DataFrame:
    """macd, macds (its signal line) and macdh (their gap)."""
    df = over.ewm(df, {"_fast": (value, span(fast)), "_slow": (value, span(slow))}, by, order)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = over.ewm(df, {"macds": ("macd", span(signal))}, by, order)
    return df.withColumn("macdh", F.col("macd") - F.col("macds"))


def rsi(df: DataFrame, n: int = 14, value: str = "close", by=("symbol",), order="date", over=_HERE) -> DataFrame:
    """rsi from 0 to 100; the first row counts as no change, 100 where nothing fell, null where nothing moved."""
    df = over.previous(df, {"_before": value}, by, order)
    df = df.withColumn("_d", F.coalesce(F.col(value) - F.col("_before"), F.lit(0.0))).withColumn("_gain", F.greatest("_d", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = over.ewm(df, {"_up": ("_gain", 1 / n), "_down": ("_loss", 1 / n)}, by, order)
    return df.withColumn("rsi", 100 * F.try_divide(F.col("_up"), F.col("_up") + F.col("_down"))).drop("_before", "_d", "_gain", "_loss", "_up", "_down")


def atr(df: DataFrame, n: int = 14, by=("symbol",), order="date", over=_HERE) -> DataFrame:
    """Average true range; the first row's range is high less low."""
    df = over.previous(df, {"_before": "close"}, by, order)
    prev = F.coalesce(F.col("_before"), F.col("close"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return over.ewm(df.withColumn("_tr", true_range), {"atr": ("_tr", 1 / n)}, by, order).drop("_tr", "_before")


#: Names that a caller may ask for.
NAMES = ("close_50_sma", "close_200_sma", "close_10_ema", "macd", "macds", "macdh", "rsi", "boll", "boll_ub", "boll_lb", "atr", "vwma", "mfi")
#: What each kind of source may be asked for.
SERVED = {"computed": NAMES, "vendor": tuple(n for n in NAMES if n != "mfi")}
#: The set of the verified snapshot.
SNAPSHOT = tuple(n for n in NAMES if n not in ("vwma", "mfi"))
#: Newest rows of a snapshot, at most.
RECENT = 30
_OPEN = re.compile(r"(open|high|low|close|volume)_(\d+)_(sma|ema)")


def parse_names(text: str) -> list[str]:
    """Names separated by commas, trimmed and in lower case."""
    return [n.strip().lower() for n in text.split(",") if n.strip()]


def is_known(name: str, source: str = "computed") -> bool:
    return name in SERVED[source] or (source == "computed" and bool(_OPEN.fullmatch(name)))


def _errors(df: DataFrame, names: list[str]) -> DataFrame:
    """One row for each unknown name: indicator, date, value, status, error."""
    rows = [(n, f"unknown indicator {n}; known are {', '.join(NAMES)}") for n in names]
    out = df.sparkSession.createDataFrame(rows, "indicator string, error string")
    return out.select("indicator", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("value"), F.lit("error").alias("status"), "error")


def requested(bars: DataFrame, names: str, date, days: int = 30, source: str = "computed") -> DataFrame:
    """indicator, date, value, status, error of one symbol's bars for every calendar day of the look-back. Names are separated by commas; an unknown one has a row with its error."""
    wanted = list(dict.fromkeys(parse_names(names)))
    known, unknown = [n for n in wanted if is_known(n, source)], [n for n in wanted if not is_known(n, source)]
    out = _errors(bars, unknown)
    if known:
        values = long_form(with_indicators(bars, known), known)
        dense = calendar_dense(values, "value", date, days, by=("indicator",))
        out = dense.select("indicator", "date", "value", "status", F.lit(None).cast("string").alias("error")).unionByName(out)
    return out


def snapshot(bars: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """symbol, indicator, date, value, error: the newest row of each symbol in long form. A name that is unknown, or can't be computed from these columns, has its error and leaves the others as they are."""
    return verified(bars, names).where("section = 'indicator'").drop("section")


def failures(bars: DataFrame, names) -> dict[str, str]:
    """The error of each name that can't be computed from the columns of the bars."""
    out = {}
    for n in names:
        try:
            with_indicators(bars, [n]).schema  # noqa: B018 - the plan is made and checked, nothing runs
        except ValueError:
            out[n] = f"unknown indicator {n}"
        except AnalysisException as e:
            out[n] = f"{n} can't be computed: {e.getCondition() or 'error'}"
    return out


def verified(bars: DataFrame, names: tuple[str, ...] | None = None, look_back: int = RECENT) -> DataFrame:
    """symbol, section, indicator, date, value, error of each symbol: the fields of its newest bar (section ``bar``), the
    indicators there (``indicator``), and its newest closes (``close``, from 1 to RECENT rows). One pass over the bars.
    """
    names = tuple(dict.fromkeys(names or SNAPSHOT))
    wrong = failures(bars, names)
    known = [n for n in names if n not in wrong]
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("date").desc()))
    some = with_indicators(bars, known).withColumn("_rank", rank).where(F.col("_rank") <= max(1, min(look_back, RECENT)))
    kept = lambda section, name, value, error=None: F.struct(F.lit(section).alias("section"), F.lit(name).alias("indicator"), value.cast("double").alias("value"), F.lit(error).cast("string").alias("error"))
    there = {c.lower(): c for c in bars.columns}
    newest = [kept("bar", c.capitalize(), F.col(there[c])) for c in ("open", "high", "low", "close", "volume") if c in there]
    newest += [kept("indicator", n, F.lit(None) if n in wrong else F.col(n), wrong.get(n)) for n in names]
    close = F.array(kept("close", "Close", F.col("close")))
    return some.select("symbol", "date", F.inline(F.when(F.col("_rank") == 1, F.concat(F.array(*newest), close)).otherwise(close))).select("symbol", "section", "indicator", "date", "value", "error")


#: What a vendor's indicator can be asked for.
INTERVALS, PRICES = ("daily", "weekly", "monthly"), ("open", "high", "low", "close")


def resampled(bars: DataFrame, interval: str = "daily") -> DataFrame:
    """Bars of weeks (from Monday) or months, dated by their last row."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; known are {', '.join(INTERVALS)}")
    if interval == "daily":
        return bars
    first, last = (lambda c: F.min_by(c, "date").alias(c)), (lambda c: F.max_by(c, "date").alias(c))
    rows = bars.groupBy("symbol", F.date_trunc("week" if interval == "weekly" else "month", "date").alias("_period"))
    return rows.agg(F.max("date").alias("date"), first("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close"), F.sum("volume").alias("volume")).drop("_period")


def parameterised(bars: DataFrame, function: str, interval: str = "daily", time_period: int = 14, series_type: str = "close") -> DataFrame:
    """symbol, date and value of sma, ema, rsi, atr, vwma, boll, boll_ub or boll_lb over so many rows of bars of the interval. series_type: the price that it is of (not for atr and vwma)."""
    if series_type not in PRICES:
        raise ValueError(f"unknown series type {series_type!r}; known are {', '.join(PRICES)}")
    df = resampled(bars, interval)
    if function == "sma":
        df = df.withColumn("value", sma(series_type, time_period))
    elif function == "ema":
        df = ema(df, time_period, series_type, "value")
    elif function == "rsi":
        df = rsi(df, time_period, series_type).withColumnRenamed("rsi", "value")
    elif function == "atr":
        df = atr(df, time_period).withColumnRenamed("atr", "value")
    elif function == "vwma":
        df = df.withColumn("value", vwma(time_period))
    elif function in ("boll", "boll_ub", "boll_lb"):
        df = bollinger(df, series_type, time_period).withColumnRenamed(function, "value")
    else:
        raise ValueError(f"unknown indicator {function!r}")
    return df.select("symbol", "date", "value")


def with_indicators(df: DataFrame, names: list[str] | tuple[str, ...], by=("symbol",), order="date") -> DataFrame:
    """Adds the named indicators, each family once. An unknown name is an error."""
    wanted = set(names)
    open_names = {n: _OPEN.fullmatch(n) for n in wanted}
    unknown = sorted(n for n in wanted if n not in NAMES and not open_names[n])
    if unknown:
        raise ValueError(f"unknown indicators {unknown}; known are {list(NAMES)} and <column>_<rows>_<sma|ema>")
    kept = list(df.columns)
    for n, m in open_names.items():
        if m and m[3] == "sma":
            df = df.withColumn(n, sma(m[1], int(m[2]), by, order))
    emas = {n: (m[1], span(int(m[2]))) for n, m in open_names.items() if m and m[3] == "ema"}
    df = ewm(df, emas, by, order) if emas else df
    if wanted & {"boll", "boll_ub", "boll_lb"}:
        df = bollinger(df, by=by, order=order)
    if "vwma" in wanted:
        df = df.withColumn("vwma", vwma(by=by, order=order))
    df = mfi(df, by=by, order=order) if "mfi" in wanted else df
    df = macd(df, by=by, order=order) if wanted & {"macd", "macds", "macdh"} else df
    df = rsi(df, by=by, order=order) if "rsi" in wanted else df
    df = atr(df, by=by, order=order) if "atr" in wanted else df
    return df.select(*kept, *(n for n in dict.fromkeys(names) if n not in kept))


def long_form(df: DataFrame, names: list[str] | tuple[str, ...], by=("symbol",), order="date") -> DataFrame:
    """symbol, date, indicator, value."""
    pairs = F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(n).cast("double").alias("value")) for n in names))
    return df.select(*by, order, F.inline(pairs))
