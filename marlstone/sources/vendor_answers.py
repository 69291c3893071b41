"""A second source of the request API: a vendor's recorded answers as text, in the shapes that it sends them.

Answers are a table of method, symbol and body, with a size (compact or full) for prices. A body that is the vendor's notice, not an answer, is
told by its words: a rate limit or a missing key makes the router go on to the next source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoData, NotConfigured, RateLimited
from ..functions import symbols
from ..functions.text import classify_notice
from ..operators import cleaning, news, statements
from . import payloads
from .routing import Router


@dataclass
class VendorAnswers:
    """answers (method, symbol, size, body: strings); today: the date that the answers are of, by which the length of a price answer is chosen."""

    answers: DataFrame
    today: str

    def register(self, router: Router, name: str) -> None:
        """Serves the methods that the vendor has under its name, after the sources that are there."""
        serve: dict[str, Callable] = {"get_stock_data": self._prices, "get_fundamentals": self._profile, "get_news": self._news, "get_insider_transactions": self._insiders}
        serve |= {f"get_{s}": self._statement(s) for s in ("balance_sheet", "cashflow", "income_statement")}
        for method, call in serve.items():
            router.register(method, name, call)

    def _body(self, method: str, symbol: str, size: str | None = None) -> DataFrame:
        """The answer's row; a symbol without one is no data, a notice is an error of its kind."""
        rows = self.answers.where((F.col("method") == method) & (F.col("symbol") == symbols.normalize_symbol(F.lit(symbol))))
        rows = (rows if size is None else rows.where(F.col("size") == size)).limit(1)
        notice = F.coalesce(F.get_json_object("body", "$.Information"), F.get_json_object("body", "$.Note"), F.get_json_object("body", "$['Error Message']"))
        found = rows.select(notice.alias("notice"), classify_notice(notice).alias("kind")).first()
        if found is None:
            raise NoData(symbol, detail="the vendor has no answer")
        if found["kind"] == "rate_limited":
            raise RateLimited(found["notice"])
        if found["kind"] == "not_configured":
            raise NotConfigured(found["notice"])
        if found["kind"] is not None:
            raise NoData(symbol, detail=found["notice"])
        return rows

    def _prices(self, symbol: str, start: str, end: str) -> DataFrame:
        rows = payloads.daily_csv(self._body("get_stock_data", symbol, payloads.output_size(start, self.today)), "body", start, end)
        return cleaning.round_prices(cleaning.require_fresh(cleaning.require_rows(rows, symbol), end, symbol))

    def _profile(self, symbol: str, date: str | None) -> DataFrame:
        return cleaning.require_rows(payloads.profile(self._body("get_fundamentals", symbol), "body"), symbol, "no profile field has a value")

    def _news(self, symbol: str, start: str, end: str) -> DataFrame:
        rows = payloads.feed_articles(self._body("get_news", symbol), "body", ("symbol",))
        return cleaning.require_rows(rows.where(news.in_window(F.col("published").cast("timestamp_ntz"), start, end)), symbol)

    def _insiders(self, symbol: str) -> DataFrame:
        return payloads.insider_rows(self._body("get_insider_transactions", symbol), "body")

    def _statement(self, statement: str) -> Callable:
        def serve(symbol: str, freq: str, date: str | None) -> DataFrame:
            rows = payloads.statement_reports(self._body(f"get_{statement}", symbol), "body").where(F.col("freq") == freq.lower())
            rows = statements.known_periods(rows, date) if date else rows
            return cleaning.require_rows(rows.select("period_end", "line_item", "value"), symbol)

        return serve
