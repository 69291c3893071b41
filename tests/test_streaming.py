"""Streams over the events table."""

from pyspark.sql import functions as F

from marlstone.streaming import runs

FOLDER = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_windowed_bars(spark, tmp_path):
    df, s = stream(spark, tmp_path)
    runs.run_to_table(runs.windowed_bars(s, "event_type", "ts", "value", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = df.agg(F.to_date(F.max("ts"))).first()[0]
    want = df.where(F.to_date("ts") < F.lit(last)).groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    assert got.select(F.to_date("start").alias("d"), "event_type", "high", "n").exceptAll(want).isEmpty() and want.count() == got.count()


def test_dedup_messages(spark, tmp_path):
    df, s = stream(spark, tmp_path)
    runs.run_to_table(runs.dedup_messages(s, "user_id", "ts", "400 days").select("user_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.select("user_id").distinct().count()


def test_last_state(spark, tmp_path):
    df, s = stream(spark, tmp_path)
    q = runs.last_state(s, ["user_id"], "value", "event_id").writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = df.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    assert spark.table("state").exceptAll(want).isEmpty()


def test_sessions(spark, tmp_path):
    df, s = stream(spark, tmp_path)
    runs.run_to_table(runs.sessions(s, "user_id", "ts", "1 day", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = df.agg(F.max("ts")).first()[0]
    batch = df.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    # Compared as text: a bound on the window would be applied to single rows before they are sessions.
    rows = lambda d, w: {(r["user_id"], r["s"], r["e"], r["n"]) for r in d.select("user_id", F.col(f"{w}start").cast("string").alias("s"), F.col(f"{w}end").cast("string").alias("e"), "n").collect()}
    want = {r for r in rows(batch, "session_window.") if r[2] <= str(last)}
    assert rows(got, "") == want and want
