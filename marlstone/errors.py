"""What can go wrong when a source is asked for data."""

from __future__ import annotations

from dataclasses import dataclass


class SourceError(Exception):
    """Any failure of a source."""


class RateLimited(SourceError):
    """The source asks to come back later; retry_after: what it says about when, if anything."""

    def __init__(self, message: str = "", retry_after: str | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class NotConfigured(SourceError, ValueError):
    """The source lacks a key or a setting."""


@dataclass(eq=False)
class NoData(SourceError):
    """The source answers but has no rows for the request."""

    symbol: str
    canonical: str | None = None
    detail: str = ""

    def __str__(self) -> str:
        known_as = f", known as {self.canonical}" if self.canonical not in (None, self.symbol) else ""
        return f"nothing for {self.symbol}{known_as}" + (f": {self.detail}" if self.detail else "")


class StaleData(NoData):
    """The newest row is too old for the request."""
