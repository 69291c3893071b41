"""Typed decisions as text, as Column expressions: one text for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels that readers of the texts look for.
PLAN = ("Recommendation", "Rationale", "Strategic Actions")
PROPOSAL = ("Action", "Reasoning", "Entry Price", "Stop Loss", "Position Sizing")
DECISION = ("Rating", "Executive Summary", "Investment Thesis", "Price Target", "Time Horizon")
CLOSING = "FINAL TRANSACTION PROPOSAL"


def _field(label: str, value: Column) -> Column:
    """Null without a value, so the field is left out."""
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"**{label}**: "), text))


def _sections(labels: tuple[str, ...], values: tuple[Column, ...], *more: Column) -> Column:
    return F.concat_ws("\n\n", *(_field(k, v) for k, v in zip(labels, values, strict=True)), *more)


def research_plan(recommendation: Column, rationale: Column, actions: Column) -> Column:
    return _sections(PLAN, (recommendation, rationale, actions))


def trader_proposal(action: Column, reasoning: Column, entry: Column, stop: Column, sizing: Column) -> Column:
    """Prices and sizing may be null; the last line repeats the action in capitals."""
    return _sections(PROPOSAL, (action, reasoning, entry, stop, sizing), F.concat(F.lit(f"{CLOSING}: **"), F.upper(action), F.lit("**")))


def portfolio_decision(rating: Column, summary: Column, thesis: Column, target: Column, horizon: Column) -> Column:
    """Target and horizon may be null."""
    return _sections(DECISION, (rating, summary, thesis, target, horizon))


def in_range(value: Column, least: float, most: float) -> Column:
    """The value itself; one outside the range is an error."""
    problem = F.raise_error(F.concat(F.lit(f"outside {least} to {most}: "), value.cast("string")))
    return F.when(value.isNull() | value.between(least, most), value).otherwise(problem.cast("double"))


def sentiment_report(band: Column, score: Column, confidence: Column, narrative: Column) -> Column:
    """A head of band, score out of 10 (checked) and confidence, then the narrative."""
    first = F.concat(F.lit("**Overall Sentiment:** **"), band, F.format_string("** (Score: %.1f/10)", in_range(score, 0, 10)))
    second = F.concat(F.lit("**Confidence:** "), F.upper(F.left(confidence, F.lit(1))), F.lower(F.substring(confidence, 2, 99)))
    return F.concat_ws("\n", first, second, F.lit(""), narrative)
