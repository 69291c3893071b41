"""A store of run checkpoints as a table: thread, step, and whatever state goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import thread_key


def latest_step(store: DataFrame, symbol: str | None = None, date: str | None = None) -> DataFrame:
    """The newest step of every thread, or of that of a symbol and a date; a thread without checkpoints has no row."""
    rows = store if symbol is None else store.where(F.col("thread") == thread_key(F.lit(symbol), F.lit(date)))
    return rows.groupBy("thread").agg(F.max("step").alias("step"))


def clear(store: DataFrame, symbol: str | None = None, date: str | None = None) -> DataFrame:
    """The store without the rows of one thread, or without any."""
    if symbol is None:
        return store.where(F.lit(False))
    return store.where(~(F.col("thread") == thread_key(F.lit(symbol), F.lit(date))))
