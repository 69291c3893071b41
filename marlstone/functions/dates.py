"""Column functions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_date(text: Column) -> Column:
    """ISO date, null if it is none."""
    return text.try_cast("date")


def parsed_instant(text: Column) -> Column:
    """ISO-8601 time with an offset or Z as a time in UTC without zone; null if it is none."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a time in UTC without zone."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def next_weekday(date: Column) -> Column:
    """The date itself, or the Monday after a weekend."""
    day = F.weekday(date)
    return F.when(day >= 5, F.date_add(date, F.lit(7) - day)).otherwise(date)


def strict_date(text: Column) -> Column:
    """ISO date; what is none is an error. Null stays null."""
    parsed = F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(parsed, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")))


def from_epoch_local(seconds: Column, zone: str) -> Column:
    """Epoch seconds as the wall clock of a zone shows them, without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), from_epoch(seconds))


def compact_from_text(text: Column) -> Column:
    """A date, or a date with hours and minutes, in the compact form; what is in it already stays. Anything else is an error."""
    day, minute = F.try_to_timestamp(text, F.lit("yyyy-M-d")), F.try_to_timestamp(text, F.lit("yyyy-M-d H:m"))
    made = F.coalesce(compact_time(day), compact_time(minute), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("unknown form of a date: "), text)).cast("string")))
    return F.when((F.length(text) == 13) & text.contains("T"), text).otherwise(made)


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmm")
