"""Report trees written by executors."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.errors import NoData
from marlstone.sources import report_files as rf

SECTIONS = {"analysts": {"market": "market", "news": "news"}, "research": {"manager": "plan"}, "trading": {"trader": "trade"}}


def states(spark):
    rows = [("A", "MKT", None, "PLAN", "é\nx"), ("B c+%", None, " \n", None, None), ("C", None, "N", "", "T")]
    return spark.createDataFrame(rows, "run string, market string, news string, plan string, trade string")


def tree(path):
    (version,) = rf.versions(str(path))
    return {str(p.relative_to(path / version)): p.read_text() for p in (path / version).rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_tree(spark, tmp_path):
    rf.write_files(rf.tree_rows(states(spark), SECTIONS).repartition(3), str(tmp_path / "t"))
    got = tree(tmp_path / "t")
    assert set(got) == {"A/1_analysts/market.md", "A/2_research/manager.md", "A/3_trading/trader.md", "A/complete_report.md", "C/1_analysts/news.md", "C/3_trading/trader.md", "C/complete_report.md"}
    assert got["A/3_trading/trader.md"] == "é\nx"
    assert got["C/complete_report.md"] == "# Report: C\n\n## 1. analysts\n\n### news\n\nN\n\n## 3. trading\n\n### trader\n\nT\n"


def test_states_logs_and_tables(spark, tmp_path):
    messages = spark.createDataFrame([("A", 2, "x\ny"), ("A", 1, "z"), ("B c+%", 1, None)], "run string, turn int, text string")
    rows = rf.state_rows(states(spark)).unionByName(rf.log_rows(messages, ["turn"], F.concat_ws(" ", F.col("turn").cast("string"), "text")))
    rows = rows.unionByName(rf.table_rows(messages, ["turn", "text"], [F.col("turn").desc()], 1))
    rf.write_files(rows, str(tmp_path / "t"))
    got = tree(tmp_path / "t")
    assert json.loads(got["C/state.json"]) == {"run": "C", "news": "N", "plan": "", "trade": "T"}
    assert got["A/messages.log"] == "1 z\n2 x y\n" and got["B c+%/messages.log"] == "1\n"
    assert got["A/table.md"] == "Total records: 2\n\n| turn | text |\n| --- | --- |\n| 2 | x\ny |\n\n_(1 of 2 rows)_\n"
    assert sorted(tuple(r) for r in rf.read_files(spark, str(tmp_path / "t")).collect()) == sorted((*k.split("/", 1), v) for k, v in got.items())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(NoData):
        rf.read_files(spark, path)
    good = rf.tree_rows(states(spark), SECTIONS)
    rf.write_files(good, path)
    before = sorted(str(p) for p in Path(path).rglob("*"))
    for wrong in ("../out", "a//b", "/x"):
        bad = good.withColumn("path", F.when(F.col("run") == "C", wrong).otherwise(F.col("path"))).repartition(4, "path")
        with pytest.raises(Exception, match="no path inside"):
            rf.write_files(bad, path)
        assert rf.read_files(spark, path).count() == 7 and len(rf.versions(path)) == 1
        rf.vacuum(path)
        assert sorted(str(p) for p in Path(path).rglob("*")) == before
    assert not (tmp_path / "out").exists()


def test_append_and_overwrite(spark, tmp_path):
    path, good = str(tmp_path / "t"), rf.tree_rows(states(spark), SECTIONS)
    rf.write_files(good.where("run = 'A'"), path)
    rf.write_files(good.where("run = 'C'"), path)
    assert rf.read_files(spark, path).count() == 7
    rf.write_files(good.where("run = 'C'"), path, "overwrite")
    assert rf.read_files(spark, path).count() == 3 and len(list(Path(path).glob("v-*"))) == 1


def test_reading_takes_no_listing_and_few_tasks(spark, tmp_path):
    """Tasks are as many as cores, not as some files; files that are in no list, and empty ones, are told apart."""
    rows = spark.range(600).select(F.concat(F.lit("r%+ "), "id").alias("run"), F.lit("a/b.md").alias("path"), F.when(F.col("id") > 0, F.concat(F.lit("t\n"), "id")).otherwise("").alias("text"))
    rf.write_files(rows, str(tmp_path / "t"))
    (version,) = rf.versions(str(tmp_path / "t"))
    (tmp_path / "t" / version / "r%+ 1" / "stray.md").write_text("of a task that was given up")
    df = rf.read_files(spark, str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
