"""The log of decisions: appended while pending, resolved with outcomes later.

A log is a DataFrame of date, symbol, rating, pending, raw, alpha, holding, decision,
reflection and seq (its order). Every operation returns the new log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["date", "symbol"]


def append_pending(log: DataFrame, new: DataFrame, last: int | None = None) -> DataFrame:
    """Adds pending entries (date, symbol, rating, decision) whose key is not pending yet; of several with one key the first by decision stays.

    They are numbered from the greatest seq of the log on, or from ``last`` if that is known.
    """
    open_keys = log.where("pending").select(*KEY).distinct()
    fresh = new.groupBy(*KEY).agg(F.min(F.struct("decision", "rating")).alias("_r")).select(*KEY, "_r.rating", "_r.decision").join(open_keys, KEY, "left_anti")
    # Numbers in order of the keys: ranks within a date, after the counts of earlier dates (one row for each date).
    before = fresh.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("date", F.coalesce(F.sum("_n").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    fresh = fresh.withColumn("_rank", F.row_number().over(W.partitionBy("date").orderBy("symbol"))).join(before, "date")
    kinds = {f.name: f.dataType for f in log.schema}
    if last is None:
        fresh = fresh.crossJoin(F.broadcast(log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))))  # one row
    else:
        fresh = fresh.withColumn("_last", F.lit(last))
    numbered = fresh.withColumn("seq", F.col("_last") + F.col("_before") + F.col("_rank"))
    made = {"pending": F.lit(True), "seq": F.col("seq").cast(kinds["seq"])}
    cols = [made[c].alias(c) if c in made else F.col(c).cast(kinds[c]).alias(c) if c in (*KEY, "rating", "decision") else F.lit(None).cast(kinds[c]).alias(c) for c in log.columns]
    return log.unionByName(numbered.select(*cols))


def resolve(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets the outcome (raw, alpha, holding, reflection) of the first pending entry of each updated key; each update is used once.

    Of several updates of a key the least by their values counts, in the order raw, alpha, holding, reflection.
    """
    w = W.partitionBy(*KEY, "pending").orderBy("seq")
    rows = log.withColumn("_first", F.col("pending") & (F.row_number().over(w) == 1))
    new = [c for c in ("raw", "alpha", "holding", "reflection") if c in updates.columns]
    once = updates.groupBy(*KEY).agg(F.min(F.struct(*(F.col(c).alias(f"_{c}") for c in new))).alias("_u"))
    rows = rows.join(once, KEY, "left")
    hit = F.col("_first") & F.col("_u").isNotNull()
    rows = rows.withColumns({c: F.when(hit, F.col(f"_u._{c}")).otherwise(F.col(c)) for c in new})
    return rows.withColumn("pending", F.col("pending") & ~hit).select(*log.columns)


def rotate(log: DataFrame, most: int | None) -> DataFrame:
    """Drops the oldest resolved entries beyond ``most``; pending ones stay."""
    if not most or most <= 0:
        return log
    resolved = log.where("NOT pending").orderBy(F.col("seq").desc()).limit(most)
    return log.where("pending").unionByName(resolved)


def past_context(log: DataFrame, symbol: str, same: int = 5, cross: int = 3) -> DataFrame:
    """The newest resolved entries of the symbol and of others, by log order, with ``kind`` and ``rank``."""
    done = log.where("NOT pending")
    out = None
    for kind, rows, n in (("same", done.where(F.col("symbol") == symbol), same), ("cross", done.where(F.col("symbol") != symbol), cross)):
        top = rows.orderBy(F.col("seq").desc()).limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.col("seq").desc()))).withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out


def pending(log: DataFrame, symbol: str | None = None) -> DataFrame:
    rows = log.where("pending")
    return rows if symbol is None else rows.where(F.col("symbol") == symbol)
