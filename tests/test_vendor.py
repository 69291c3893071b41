"""The vendor's bars as a data source, over recorded answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.sources import vendor
from marlstone.streaming import runs

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
D0 = dt.date(2024, 1, 1)


def bars(spark, days=90, symbols="abcde", first=0):
    rows = [(s, D0 + dt.timedelta(i), float(i), i + 1.0, i - 1.0, None if i % 9 == 0 else i + 0.5, 10.0) for s in symbols for i in range(first, days, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def recorded(spark, tmp_path):
    vendor.use_vendor(spark)
    vendor.record(bars(spark), f"file://{tmp_path}/answers")
    return lambda **options: spark.read.format("vendor_bars").option("path", f"file://{tmp_path}/answers").options(**options).load()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_all_rows(spark, recorded):
    assert rows(recorded()) == rows(bars(spark)) and recorded(per_task=1).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("bound", ["symbol = 'b'", "symbol IN ('a', 'e', 'zz')", "date >= DATE '2024-02-10'", "date > DATE '2024-02-10' AND date < DATE '2024-02-20'", "symbol = 'c' AND date = DATE '2024-01-03'", "date BETWEEN DATE '2024-01-20' AND DATE '2024-02-05' AND close > 25", "symbol = 'a' AND symbol = 'b'", "date > DATE '2024-02-10' AND date < DATE '2024-02-01'", "symbol > 'c' OR close < 4"])
def test_bounds_are_pushed(spark, recorded, bound):
    assert rows(recorded(per_task=1).where(bound)) == rows(bars(spark).where(bound))


def test_bounds_in_the_plan_and_fewer_tasks(spark, recorded):
    df = recorded(per_task=1).where("symbol = 'b' AND date >= DATE '2024-02-10'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Nothing is left for Spark to filter: the source has taken the bounds.
    assert df.rdd.getNumPartitions() == 1 and "BatchScan vendor_bars" in plan and "Filter (" not in plan
    assert recorded(symbols="a, d", start="2024-02", end="2024-02").agg(F.min("date"), F.max("date"), F.count_distinct("symbol")).first()[:] == (dt.date(2024, 2, 2), dt.date(2024, 2, 28), 2)


def test_files_and_tasks_do_not_grow_with_symbols(spark, tmp_path):
    """Answers are many to a file and a task reads a file, so both are bounded; names of any kind and appended months come back."""
    vendor.use_vendor(spark)
    many = spark.range(1200).select(F.concat(F.lit("s/é="), "id").alias("symbol"), F.date_add(F.lit(D0), (F.col("id") % 50).cast("int")).alias("date"), *(F.col("id").cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
    for part in (many, many.withColumn("date", F.date_add("date", 3))):
        vendor.record(part, f"file://{tmp_path}/many")
    df = spark.read.format("vendor_bars").option("path", f"file://{tmp_path}/many").load()
    assert len(list((tmp_path / "many").rglob("*.parquet"))) <= 2 * vendor.BUCKETS and df.rdd.getNumPartitions() <= vendor.BUCKETS
    assert rows(df) == rows(many.unionByName(many.withColumn("date", F.date_add("date", 3))))
    assert rows(df.where("symbol = 's/é=7'")) == rows(many.unionByName(many.withColumn("date", F.date_add("date", 3))).where("symbol = 's/é=7'"))


def test_limited_answers_are_asked_again(spark, recorded, tmp_path):
    (tmp_path / "limits").write_text("2")
    flaky = {"client": "tests.flaky_vendor:Flaky", "pause": 0, "per_task": 2}
    assert rows(recorded(**flaky)) == rows(bars(spark))
    assert len(list((tmp_path / "calls").glob("a.2024-01.*"))) == 3
    (tmp_path / "limits").write_text("99")
    with pytest.raises(Exception, match="later"):
        recorded(**flaky, retries=1).collect()


def test_as_a_stream(spark, recorded, tmp_path):
    """Each run reads the days since the one before, from the checkpoint; a run with nothing new adds nothing."""
    stream = lambda: spark.readStream.format("vendor_bars").option("path", f"file://{tmp_path}/answers").load()
    run = lambda: runs.run_to_table(stream(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(bars(spark))
    run()
    vendor.record(bars(spark, 130, "abcdef", 90), f"file://{tmp_path}/answers")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(bars(spark).unionByName(bars(spark, 130, "abcdef", 90)))
