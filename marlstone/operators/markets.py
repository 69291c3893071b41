"""Prediction markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_probability, json_strings


def unnest_markets(answers: DataFrame, events: str = "events", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each market of each event, with its place in the answer."""
    rows = answers.select(*keys, F.posexplode(events).alias("event_no", "_e"))
    rows = rows.select(*keys, "event_no", F.posexplode("_e.markets").alias("market_no", "_m"))
    return rows.select(*keys, "event_no", "market_no", "_m.*")


def is_forward_looking(now, closed: str = "closed", end: str = "endDate", prices: str = "outcomePrices", outcomes: str = "outcomes") -> Column:
    """Open, not past its end (an end that is no time doesn't count), with prices and outcomes."""
    ends = F.coalesce(F.try_to_timestamp(F.col(end)), F.try_to_timestamp(F.concat(F.col(end), F.lit("T00:00:00Z"))))
    past = F.coalesce(ends < F.lit(now).cast("timestamp"), F.lit(False))
    # The cheap tests first: the lists are parsed only of markets that pass them.
    listed = (F.size(json_strings(F.col(prices))) > 0) & (F.size(json_strings(F.col(outcomes))) > 0)
    return F.when(~F.coalesce(F.col(closed), F.lit(False)) & ~past, listed).otherwise(False)


def top_markets(markets: DataFrame, limit: int = 6, volume: str = "volumeNum", order: tuple[str, ...] = ("event_no", "market_no")) -> DataFrame:
    """The most traded markets (no volume ranks as 0, ties by place); one whose first price is no number is dropped after the limit."""
    top = markets.withColumn("_v", F.coalesce(F.col(volume).cast("double"), F.lit(0.0))).orderBy(F.col("_v").desc(), *order).limit(limit)
    prices, outcomes = json_strings(F.col("outcomePrices")), json_strings(F.col("outcomes"))
    top = top.withColumn("probability", first_probability(prices)).withColumn("label", F.coalesce(F.try_element_at(outcomes, F.lit(1)), F.lit("Yes")))
    return top.withColumn("volume", F.col("_v")).drop("_v").where("probability IS NOT NULL")
