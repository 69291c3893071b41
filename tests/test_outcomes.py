"""The life of decisions as a stream, against the batch operator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import timeseries
from marlstone.streaming import outcomes, runs

D0 = dt.date(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    with runs.rocksdb(spark):
        yield spark


def market(spark, seed, symbols=6, days=60):
    """Bars with holes, a benchmark with other holes, and decisions on any day; some symbols have no bars or one."""
    r = random.Random(seed)
    day = lambda i: D0 + dt.timedelta(i)
    bars = [(f"s{s}", day(i), 100 + r.random() * 20) for s in range(symbols) for i in range(days) if r.random() < (0.2, 0.9, 0.6, 0.05, 1.0, 0.5)[s % 6]]
    bench = [(day(i), 50 + r.random()) for i in range(days) if r.random() < 0.6]
    decisions = [(f"s{s}", day(i)) for s in range(symbols + 1) for i in range(days) if r.random() < 0.3]
    return spark.createDataFrame(decisions, "symbol string, date date"), spark.createDataFrame(bars, "symbol string, date date, close double"), spark.createDataFrame(bench, "date date, close double")


def replay(rocks, rows, tmp_path, steps, late="0 seconds"):
    """Feeds the rows in steps of dates, a query for each step on one checkpoint, so every step is a restart."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    ordered = rows.collect()
    last = max(r["date"] for r in ordered)
    clock = [(r, outcomes.CLOCK, last + dt.timedelta(40), None) for r in sorted({r["symbol"] for r in ordered})]
    for low, high in zip(steps[:-1], steps[1:], strict=True):
        part = [tuple(r) for r in ordered if low <= (r["date"] - D0).days < high] + (clock if high == steps[-1] else [])
        rocks.createDataFrame(part, outcomes.INPUT).repartition(2).write.mode("append").parquet(source)
        stream = rocks.readStream.schema(outcomes.INPUT).parquet(source)
        runs.run_to_table(outcomes.resolved(stream, late=late), out, check).awaitTermination()
    return rocks.read.parquet(out)


def key(df):
    rounded = lambda x: None if x is None else round(x, 9)
    return sorted(((r["symbol"], r["date"], r["days"], rounded(r["raw"]), rounded(r["alpha"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("steps", [[0, 200], [0, 7, 31, 33, 200]])
def test_like_the_batch_operator(rocks, tmp_path, steps):
    """In one batch and in several, each a restart from the checkpoint: the same rows, each once."""
    decisions, bars, bench = market(rocks, 3)
    got = replay(rocks, outcomes.outcome_rows(decisions, bars, bench), tmp_path, steps)
    want = timeseries.holding_outcome(decisions, bars, bench).select("symbol", "date", "days", "raw", "alpha")
    assert key(got) == key(want)


def test_rows_out_of_order_within_the_watermark(rocks, tmp_path):
    """Bars come up to twelve days late, decisions twice."""
    decisions, bars, bench = market(rocks, 5, symbols=3, days=40)
    rows = outcomes.outcome_rows(decisions.unionByName(decisions), bars, bench)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = rows.where((F.col("date") < F.lit("2024-01-20")) & (F.dayofmonth("date") % 2 == 0))
    rest = rows.where((F.col("date") < F.lit("2024-01-20")) & (F.dayofmonth("date") % 2 == 1))
    end = rows.where(F.col("date") >= F.lit("2024-01-20")).unionByName(rows.select("symbol", F.lit(outcomes.CLOCK).alias("kind"), F.lit("2024-06-01").cast("date").alias("date"), F.lit(None).cast("double").alias("close")).distinct())
    for part in (first, rest, end):
        part.write.mode("append").parquet(source)
        runs.run_to_table(outcomes.resolved(rocks.readStream.schema(outcomes.INPUT).parquet(source), late="20 days"), out, check).awaitTermination()
    want = timeseries.holding_outcome(decisions, bars, bench).select("symbol", "date", "days", "raw", "alpha")
    assert key(rocks.read.parquet(out)) == key(want)


def test_benchmarks_by_symbol(rocks):
    decisions = rocks.createDataFrame([("a", D0)], "symbol string, date date")
    bench = rocks.createDataFrame([("x", D0, 1.0), ("y", D0, 2.0)], "benchmark string, date date, close double")
    of = rocks.createDataFrame([("a", "y"), ("b", "x")], "symbol string, benchmark string")
    rows = outcomes.outcome_rows(decisions, decisions.withColumn("close", F.lit(3.0)), bench, of)
    assert sorted(tuple(r) for r in rows.where("kind = 'bench'").select("symbol", "close").collect()) == [("a", 2.0), ("b", 1.0)]
