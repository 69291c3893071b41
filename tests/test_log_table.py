"""The log in key ranges, against the operators on the whole log."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import decision_log
from marlstone.sources.log_table import SCHEMA, Conflict, LogTable
from marlstone.streaming import runs

NEW = "date string, symbol string, rating string, decision string"
UPDATES = "date string, symbol string, raw double, alpha double, holding int, reflection string"


def rows(df):
    return sorted((tuple(r) for r in df.select(*(c.split()[0] for c in SCHEMA.split(", "))).collect()), key=repr)


def files(path):
    """Data files with their contents' size and time of writing."""
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def of_range(found, name):
    return {p: t for p, t in found.items() if f"_range={name}" in p}


def batches(seed, n=4):
    """Entries and outcomes for keys of a few months; some come again, some outcomes have no entry, some dates are missing."""
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.05 else f"2024-0{r.randint(1, 4)}-{r.randint(1, 28):02d}"
    out = []
    for _ in range(n):
        new = [(day(), f"s{r.randint(0, 5)}", "Hold", f"d{r.randint(0, 99)}") for _ in range(40)]
        updates = [(day(), f"s{r.randint(0, 5)}", r.random(), None, 5, "seen") for _ in range(60)]
        out.append((new, updates))
    return out


@pytest.mark.parametrize(("chars", "buckets"), [(7, 1), (10, 3), (4, 1)])
def test_like_the_operators(spark, tmp_path, chars, buckets):
    table = LogTable(spark, f"file://{tmp_path}/log", chars, buckets)
    whole = spark.createDataFrame([], SCHEMA)
    for k, (new, updates) in enumerate(batches(1)):
        new, updates = spark.createDataFrame(new, NEW), spark.createDataFrame(updates, UPDATES)
        assert table.apply(k, new, updates)
        # The table's schema again, with a short lineage.
        whole = decision_log.resolve(decision_log.append_pending(whole, new), updates)
        whole = spark.createDataFrame(whole.collect(), SCHEMA)
        assert rows(table.read()) == rows(whole)
    assert rows(LogTable(spark, f"file://{tmp_path}/log").read("2024-02-10", "2024-03-05")) == rows(whole.where("date BETWEEN '2024-02-10' AND '2024-03-05'"))
    table.rotate(7)
    assert rows(table.read()) == rows(decision_log.rotate(whole, 7))
    table.vacuum()
    assert rows(table.read()) == rows(decision_log.rotate(whole, 7))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/log")
    new = spark.createDataFrame([("2024-01-02", "a", "Buy", "x")], NEW)
    assert table.apply(3, new)
    before, manifest = files(tmp_path), table.manifest()
    assert not table.apply(3, new) and not table.apply(2, new)
    assert files(tmp_path) == before and table.manifest() == manifest and table.read().count() == 1


def test_other_ranges_stay_as_they_are(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/log")
    table.apply(0, spark.createDataFrame([(f"2024-0{m}-05", s, "Buy", "x") for m in range(1, 6) for s in "abc"], NEW))
    before = files(tmp_path)
    table.apply(1, updates=spark.createDataFrame([("2024-03-05", "b", 0.5, None, 5, "seen"), ("2031-01-01", "b", 0.5, None, 5, "")], UPDATES))
    m = table.manifest()["ranges"]
    assert {r for r, v in m.items() if v["folder"].startswith("data/000000000002")} == {"2024-03.0"}
    for month in (1, 2, 4, 5):
        assert of_range(files(tmp_path), f"2024-0{month}.0") == of_range(before, f"2024-0{month}.0")
    assert table.read().where("reflection = 'seen'").count() == 1
    table.rotate(1)
    assert table.manifest()["number"] == 2


def test_a_failed_batch_leaves_the_log(spark, tmp_path):
    """A batch that breaks while it writes, and a second writer that was faster."""
    table = LogTable(spark, f"file://{tmp_path}/log")
    new = spark.createDataFrame([("2024-01-02", "a", "Buy", "x")], NEW)
    table.apply(0, new)
    before = rows(table.read())
    broken = new.withColumn("decision", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.apply(1, broken)
    assert rows(table.read()) == before and table.manifest()["batch"] == 0
    other = LogTable(spark, f"file://{tmp_path}/log")
    m = other.manifest()
    table.apply(1, new.withColumn("symbol", F.lit("b")))
    with pytest.raises(Conflict):
        other._rewrite(m, ["2024-01.0"], other.read(), batch=1)
    assert table.read().count() == 2


def test_fed_by_a_stream(spark, tmp_path):
    """Entries and outcomes of a stream in several batches, each query a restart: as if they had come at once."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    table = LogTable(spark, f"file://{tmp_path}/log")
    schema = f"{UPDATES}, rating string, decision string"
    split = lambda df: (df.where("decision IS NOT NULL").select("date", "symbol", "rating", "decision"), df.where("decision IS NULL").select("date", "symbol", "raw", "alpha", "holding", "reflection"))
    whole = spark.createDataFrame([], SCHEMA)
    for new, updates in batches(9, 3):
        part = spark.createDataFrame([(d, s, None, None, None, None, r, x) for d, s, r, x in new] + [(*u, None, None) for u in updates], schema)
        part.repartition(1).write.mode("append").parquet(source)
        runs.run_batches(spark.readStream.schema(schema).parquet(source), table.sink(split), check).awaitTermination()
        whole = spark.createDataFrame(decision_log.resolve(decision_log.append_pending(whole, split(part)[0]), split(part)[1]).collect(), SCHEMA)
    assert rows(table.read()) == rows(whole) and table.manifest()["batch"] == 2
