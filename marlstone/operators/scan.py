"""Very long series: a scan in two passes, so that one series fills many tasks.

A window by symbol puts a whole series into one task. Here a series is cut into parts of about as many rows
(:func:`cut`), windows work within a part, and what a part hands on (its last row, its last value that is
not null, its weighted sums) is one row. Those rows, a few for each long series, are combined in order
and applied to the parts. The result is that of the window over the whole series.

``previous`` and ``ewm`` have the signatures of those in :mod:`indicators`, so its functions take this module as
their ``over``: ``indicators.rsi(scan.cut(bars), over=scan)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import saved
from .indicators import weighted_sums
from .timeseries import as_of_result, as_of_rows

PART = "_part"
#: Rows of a part, about; series with no more are not cut.
ROWS = 1 << 18
#: Parts of one series, and cuts of all series together, at most.
SERIES_PARTS, CUTS = 1 << 10, 1 << 20


def _position(df: DataFrame, order: str) -> Column:
    """The order as a number."""
    kind = df.schema[order].dataType.typeName()
    if kind == "date":
        return F.unix_date(order)
    return F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order)


def cut(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "date", rows: int = ROWS) -> DataFrame:
    """Adds ``_part``, which ascends along each series; rows of one place in the order are in one part.

    Parts are cut at approximate quantiles of the long series: two aggregates over the key and the order alone. There
    are at most as many long series as ``rows`` goes into the table, and the cuts of all are held to a fixed number, so they
    are collected once and sent to every task. A null key counts as a short series.
    """
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = size.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    rows = max(rows, -(-total // CUTS))
    if largest <= rows:
        return df.withColumn(PART, F.lit(0))
    most = min(SERIES_PARTS, -(-largest // rows))
    long = size.where(F.col("_n") > rows).select(*by)
    at = _position(df, order)
    found = df.join(F.broadcast(long), list(by), "left_semi").groupBy(*by)
    found = found.agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(at, [k / most for k in range(1, most)], 10 * most).alias("_q"))
    wanted = F.least(F.lit(most), F.ceil(F.col("_n") / rows))
    found = found.select(*by, F.array_distinct(F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get("_q", (F.size("_q") * i / wanted).cast("int")))).alias("_cuts"))
    found = df.sparkSession.createDataFrame(found.collect(), found.schema)
    # How many cuts are below: a binary search.
    step = lambda low, k: low + F.when(F.get("_cuts", low + k - 1) < at, k).otherwise(0)
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    below = F.aggregate(powers, F.lit(0), step)
    return df.join(F.broadcast(found), list(by), "left").withColumn(PART, F.coalesce(below, F.lit(0))).drop("_cuts")


def _series(by: tuple[str, ...]):
    return W.partitionBy(*by).orderBy(PART)


def _apply(df: DataFrame, ends: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Joins what each part is handed. Only parts of series that are cut have a row, so their number is that of the cuts."""
    return df.join(F.broadcast(ends), [*by, PART], "left")


def _cut_only(ends: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return ends.withColumn("_parts", F.max(PART).over(W.partitionBy(*by))).where("_parts > 0").drop("_parts")


def previous(df: DataFrame, columns: dict[str, str], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """Adds the values of the row before: name -> column."""
    w = W.partitionBy(*by, PART).orderBy(order)
    row = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    ends = _cut_only(df.groupBy(*by, PART).agg(F.max_by(row, order).alias("_end")), by)
    ends = ends.select(*by, PART, F.lag("_end").over(_series(by)).alias("_end"))
    df = _apply(df.withColumn("_at", F.row_number().over(w)).withColumns({n: F.lag(c).over(w) for n, c in columns.items()}), ends, by)
    return df.withColumns({n: F.when(F.col("_at") == 1, F.col("_end")[n]).otherwise(F.col(n)) for n in columns}).drop("_at", "_end")


def fill_gaps(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """As :func:`cleaning.fill_gaps`: the last value before, else the first one after."""
    w = W.partitionBy(*by, PART).orderBy(order)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = {f"_last_{c}": F.max_by(c, known(c)) for c in columns} | {f"_first_{c}": F.min_by(c, known(c)) for c in columns}
    ends = _cut_only(df.groupBy(*by, PART).agg(*(v.alias(k) for k, v in ends.items())), by)
    before, after = _series(by).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(W.unboundedPreceding, -1)
    carried = [F.last(f"_last_{c}", True).over(before).alias(f"_before_{c}") for c in columns] + [F.last(f"_first_{c}", True).over(after).alias(f"_after_{c}") for c in columns]
    df = _apply(df, ends.select(*by, PART, *carried), by)
    # Where nothing is before, the first value after is the first of the whole part: a frame that starts anew at each row would take quadratic time.
    inside = lambda c: (F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(c, True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    filled = {c: F.coalesce(inside(c)[0], F.col(f"_before_{c}"), inside(c)[1], F.col(f"_after_{c}")) for c in columns}
    return df.withColumns(filled).drop(*(f"_{k}_{c}" for c in columns for k in ("before", "after")))


def as_of_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("symbol",), date: str = "date", prefix: str = "asof_", rows: int = ROWS) -> DataFrame:
    """As :func:`timeseries.as_of_join`, both sides cut together."""
    both = cut(as_of_rows(left, right, by, date), by, date, rows)
    ends = _cut_only(both.groupBy(*by, PART).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(date))).alias("_end")), by)
    ends = ends.select(*by, PART, F.last("_end", True).over(_series(by).rowsBetween(W.unboundedPreceding, -1)).alias("_end"))
    w = W.partitionBy(*by, PART).orderBy(date, "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = _apply(both.withColumn("_r", F.last("_r", True).over(w)), ends, by)
    return as_of_result(both.withColumn("_r", F.coalesce("_r", "_end")), left, right, by, date, prefix)


def ewm(df: DataFrame, sources: dict[str, tuple[str, float]], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """As :func:`indicators.ewm`: name -> (column, alpha). A part hands on its number of rows and the weighted sum at its last row.

    Those within the parts are read twice, so they are written to the work folder: a long chain of windows runs once.
    """
    local = saved(weighted_sums(df, sources, (*by, PART), order), "sums")
    ends = local.groupBy(*by, PART).agg(F.max("_n").alias("_m"), *(F.max_by(f"_s_{n}", "_n").alias(n) for n in sources))
    # The parts of one series are at most SERIES_PARTS rows.
    lists = _cut_only(ends, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(PART, "_m", *sources))).alias("_all"))
    each = lists.select(*by, "_all", F.explode(F.col(f"_all.{PART}")).alias(PART))
    earlier = F.filter("_all", lambda x: x[PART] < F.col(PART))
    decay = lambda name, q: F.aggregate(earlier, F.lit(0.0), lambda total, x: total * F.pow(F.lit(q), x["_m"].cast("double")) + x[name])
    carried = each.select(*by, PART, F.aggregate(earlier, F.lit(0).cast("long"), lambda total, x: total + x["_m"]).alias("_rows"), *(decay(n, 1 - a).alias(f"_c_{n}") for n, (_, a) in sources.items()))
    local = _apply(local, carried, by)
    out = {}
    for name, (_, alpha) in sources.items():
        q = F.lit(1 - alpha)
        total = F.col(f"_s_{name}") + F.pow(q, F.col("_n").cast("double")) * F.coalesce(f"_c_{name}", F.lit(0.0))
        out[name] = total * alpha / (1 - F.pow(q, (F.col("_n") + F.coalesce("_rows", F.lit(0))).cast("double")))
    return local.withColumns(out).drop("_n", "_rows", *(f"_{k}_{n}" for n in sources for k in "sc"))
