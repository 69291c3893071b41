"""Runs as a stream, against the batch operators on the same rows, in any split into batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import news, telemetry
from marlstone.streaming import run_state, runs

STAGES = ["a", "b", "c"]
SCHEMA = "run string, at timestamp, seq long, id string, text string, a string, b string, c string"
T0 = dt.datetime(2024, 1, 1)


def snapshots(seed, n=240):
    """Rows of some runs in order of time: repeated and missing ids, no messages, reports that come, go empty or are missing."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        pick = lambda: r.choice([None, None, "", "report"]) if r.random() < 0.5 else None
        out.append((f"r{r.randint(0, 6)}", T0 + dt.timedelta(seconds=20 * k), k, None if r.random() < 0.2 else f"m{r.randint(0, 25)}", None if r.random() < 0.1 else f"t{k}", pick(), pick(), pick()))
    return out


def expected(spark, rows, most):
    """By the batch operators."""
    df = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for run in sorted({r[0] for r in rows}):
        own = df.where(F.col("run") == run)
        messages = news.keep_first_known(own.where("text IS NOT NULL"), "id", ["at", "seq"])
        n = messages.count()
        for k, r in enumerate(telemetry.newest(messages, ["at", "seq"], most, by=("run",)).orderBy(F.desc("seq")).collect()):
            kept.append((run, "message", k + 1, r["id"], None, None, r["text"], n))
        last = own.groupBy("run").agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("seq"))).alias(s) for s in STAGES))
        status = {r["stage"]: r["status"] for r in telemetry.stage_status(last, STAGES).collect()}
        marks = telemetry.stage_marks(own.withColumn("at", F.unix_micros("at")), STAGES)
        wall = {r["stage"]: r["wall_s"] / 1e6 for r in telemetry.wall_times(marks, ("run", "stage")).collect()}
        kept += [(run, "stage", k + 1, s, status[s], wall.get(s), None, n) for k, s in enumerate(STAGES)]
    return sorted(kept, key=repr)


@pytest.mark.parametrize("cuts", [[0, 240], [0, 1, 90, 91, 240]])
def test_like_the_batch_operators(spark, tmp_path, cuts):
    rows = snapshots(4)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    clock = [("clock", T0 + dt.timedelta(days=9), 0, None, None, None, None, None)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows[low:high] + (clock if high == cuts[-1] else [])
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        with runs.rocksdb(spark):
            q = runs.run_to_table(run_state.run_states(spark.readStream.schema(SCHEMA).parquet(source), STAGES, most=5, idle_minutes=600), out, check)
        q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == expected(spark, rows, 5)


def test_an_idle_run_is_given_out_and_forgotten(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda minute, k: ("r", T0 + dt.timedelta(minutes=minute), k, "same", f"t{k}", "x", None, None)
    for part in ([row(0, 1)], [row(200, 2)], [("clock", T0 + dt.timedelta(days=9), 3, None, None, None, None, None)]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        with runs.rocksdb(spark):
            q = runs.run_to_table(run_state.run_states(spark.readStream.schema(SCHEMA).parquet(source), STAGES), out, check)
        q.awaitTermination()
    found = spark.read.parquet(out).where("kind = 'message' AND run = 'r'")
    assert sorted(r["text"] for r in found.collect()) == ["t1", "t2"]


def test_few_calls_of_the_state_store():
    """A run's first batch reads and writes its state once, however many messages it has: every call is a round trip."""
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *given: calls.append(name)

    tracker = run_state._Tracker(tuple(STAGES), 5, 60_000)
    tracker.handle = tracker.seen = tracker.state = Store()
    rows = [{"at_us": 10**6 * k, "seq": k, "id": f"m{k}", "text": "t", "a": None, "b": "x", "c": None} for k in range(50)]
    assert list(tracker.handleInputRows(("r",), iter(rows), None)) == []
    assert calls == ["get", "update", "registerTimer"]
