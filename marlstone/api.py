"""The requests that users make: eleven routed ones and the verified snapshot, answered with DataFrames.

An engine holds tables and serves them as the source ``tables``; further sources are registered
with its router under the same method names, and settings say who is asked in which order. An
answer's status is ok, no_data or unavailable; its value is a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import macro, symbols
from .operators import cleaning, indicators, markets, news, statements, timeseries
from .sources.routing import Answer, Router

#: How far back and how many, where a request doesn't say.
INDICATOR_DAYS, NEWS_DAYS, MACRO_DAYS = 30, 7, 365
SERIES_INFO = ("title", "units", "frequency", "adjustment")
TICKER_ARTICLES, GLOBAL_ARTICLES, MARKETS, OBSERVATIONS = 20, 10, 6, 40


@dataclass
class Engine:
    """tables: bars (symbol, date, open, high, low, close, volume), profiles (symbol and fields), statements (symbol, statement, freq,
    period_end, line_item, value), news (symbol, title, position, published; query_no if several queries gave them), insiders (symbol and fields),
    series (series, date, value), series_info (series, title, units, frequency, adjustment), markets (question, event_no, market_no, outcomes, outcomePrices, volumeNum, endDate, closed). Missing tables mean no data.
    """

    tables: dict[str, DataFrame]
    router: Router = field(default_factory=Router)

    def __post_init__(self):
        serve = {
            "get_stock_data": self._stock_data, "get_indicators": self._indicators, "get_fundamentals": self._fundamentals, "get_balance_sheet": self._statement("balance_sheet"),
            "get_cashflow": self._statement("cashflow"), "get_income_statement": self._statement("income_statement"), "get_news": self._news, "get_global_news": self._global_news,
            "get_insider_transactions": self._insiders, "get_macro_indicators": self._macro, "get_prediction_markets": self._markets,
        }
        for method, call in serve.items():
            self.router.register(method, "tables", call)

    def get_stock_data(self, symbol: str, start: str, end: str) -> Answer:
        """Daily bars from start to end, both included."""
        return self.router.ask("get_stock_data", symbol, start, end)

    def get_indicators(self, symbol: str, indicator: str, date: str, days: int = INDICATOR_DAYS) -> Answer:
        """One or several indicators, separated by commas, for every calendar day of the look-back; an unknown name has an error of its own."""
        return self.router.ask("get_indicators", symbol, indicator, date, days)

    def get_fundamentals(self, symbol: str, date: str | None = None) -> Answer:
        """Labelled profile fields; a profile has no dates, so the date changes nothing."""
        return self.router.ask("get_fundamentals", symbol, date)

    def get_balance_sheet(self, symbol: str, freq: str = "quarterly", date: str | None = None) -> Answer:
        return self.router.ask("get_balance_sheet", symbol, freq, date)

    def get_cashflow(self, symbol: str, freq: str = "quarterly", date: str | None = None) -> Answer:
        return self.router.ask("get_cashflow", symbol, freq, date)

    def get_income_statement(self, symbol: str, freq: str = "quarterly", date: str | None = None) -> Answer:
        return self.router.ask("get_income_statement", symbol, freq, date)

    def get_news(self, symbol: str, start: str, end: str) -> Answer:
        """Of the newest listed articles of a symbol, those in the window."""
        return self.router.ask("get_news", symbol, start, end)

    def get_global_news(self, date: str, days: int | None = None, limit: int | None = None) -> Answer:
        """The first distinct titles over all queries in order, ``limit`` of them, and of those the ones in the window."""
        return self.router.ask("get_global_news", date, days, limit)

    def get_insider_transactions(self, symbol: str) -> Answer:
        """No transactions are an answer, too."""
        return self.router.ask("get_insider_transactions", symbol)

    def get_macro_indicators(self, indicator: str, date: str, days: int | None = None) -> Answer:
        """The newest observations of a series by its name or id, each with the change over the whole window (n, first and last value with their dates, delta, pct) and the series' title, units, frequency and adjustment, where they are known."""
        return self.router.ask("get_macro_indicators", indicator, date, days)

    def get_prediction_markets(self, topic: str, now: str, limit: int = MARKETS) -> Answer:
        """The most traded open markets whose question has the topic."""
        return self.router.ask("get_prediction_markets", topic, now, limit)

    def get_verified_market_snapshot(self, symbol: str, date: str, days: int = indicators.RECENT, names: tuple[str, ...] | None = None) -> DataFrame:
        """The newest bar at the date, the indicators there, and the newest closes (from 1 to 30): section, indicator, date, value, error."""
        return indicators.verified(self._bars(symbol, date), names, days)

    def _table(self, name: str, symbol: str) -> DataFrame:
        if name not in self.tables:
            raise cleaning.NoData(symbol, detail=f"there is no table {name}")
        return self.tables[name]

    def _of(self, name: str, symbol: str) -> DataFrame:
        """Rows of the canonical symbol, a literal that reaches the scan."""
        return self._table(name, symbol).where(F.col("symbol") == symbols.normalize_symbol(F.lit(symbol)))

    def _bars(self, symbol: str, date: str) -> DataFrame:
        bars = cleaning.history(self._of("bars", symbol), date)
        return cleaning.require_fresh(cleaning.require_rows(bars, symbol), date, symbol)

    def _stock_data(self, symbol: str, start: str, end: str) -> DataFrame:
        bars = cleaning.between(self._of("bars", symbol), start, end)
        return cleaning.round_prices(cleaning.require_fresh(cleaning.require_rows(bars, symbol), end, symbol))

    def _indicators(self, symbol: str, indicator: str, date: str, days: int) -> DataFrame:
        return indicators.requested(self._bars(symbol, date), indicator, date, days)

    def _fundamentals(self, symbol: str, date: str | None) -> DataFrame:
        return cleaning.require_rows(statements.profile_rows(self._of("profiles", symbol)), symbol, "no profile field has a value")

    def _statement(self, statement: str):
        def serve(symbol: str, freq: str, date: str | None) -> DataFrame:
            rows = self._of("statements", symbol).where((F.col("statement") == statement) & (F.col("freq") == freq.lower()))
            rows = statements.known_periods(rows, date) if date else rows
            return cleaning.require_rows(rows.select("period_end", "line_item", "value"), symbol)

        return serve

    def _news(self, symbol: str, start: str, end: str) -> DataFrame:
        return cleaning.require_rows(news.ticker_news(self._of("news", symbol), start, end, TICKER_ARTICLES), symbol)

    def _global_news(self, date: str, days: int | None, limit: int | None) -> DataFrame:
        days, limit = NEWS_DAYS if days is None else days, GLOBAL_ARTICLES if limit is None else limit
        rows = self._table("news", "all")
        first = news.dedup_top(rows, "title", [c for c in ("query_no", "position") if c in rows.columns], limit)
        inside = news.in_window(F.col("published").cast("timestamp_ntz"), F.date_sub(F.lit(date).cast("date"), days), date)
        return cleaning.require_rows(first.where(inside), "all")

    def _insiders(self, symbol: str) -> DataFrame:
        return self._of("insiders", symbol)

    def _macro(self, indicator: str, date: str, days: int | None) -> DataFrame:
        rows = self._table("series", indicator).where(F.col("series") == macro.series_id(F.lit(indicator)))
        rows = cleaning.between(rows, F.date_sub(F.lit(date).cast("date"), MACRO_DAYS if days is None else days), date).where("value IS NOT NULL")
        shown = timeseries.recent(rows, OBSERVATIONS, ("series",), [F.col("date").desc()])
        # The change is over all observations of the window, of which there is one row.
        out = shown.join(F.broadcast(timeseries.change_over_window(rows)), "series")
        if "series_info" in self.tables:
            info = self.tables["series_info"].where(F.col("series") == macro.series_id(F.lit(indicator))).select("series", *SERIES_INFO).limit(1)
            out = out.join(F.broadcast(info), "series", "left").withColumn("title", F.coalesce("title", "series"))
        return cleaning.require_rows(out, indicator)

    def _markets(self, topic: str, now: str, limit: int) -> DataFrame:
        rows = self._table("markets", topic).where(F.lower("question").contains(topic.lower())).where(markets.is_forward_looking(now))
        return cleaning.require_rows(markets.top_markets(rows, limit), topic)
