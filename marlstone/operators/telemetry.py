"""Runs as tables: snapshots, stages, counters, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_consecutive(df: DataFrame, value: str, by: tuple[str, ...], order: list[str]) -> DataFrame:
    """Rows that repeat the value of the row before are dropped."""
    before = F.lag(F.struct(value)).over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.struct(value))).drop("_b")


def last_write(df: DataFrame, by: tuple[str, ...], value: str, order: list[str]) -> DataFrame:
    """The last value of each key that is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def wall_times(marks: DataFrame, by: tuple[str, ...], kind: str = "kind", at: str = "at") -> DataFrame:
    """Seconds from the first start to the first end of a stage, 0 at least; stages that lack one are left out."""
    start, end = F.min(F.when(F.col(kind) == "start", F.col(at))), F.min(F.when(F.col(kind) == "end", F.col(at)))
    out = marks.groupBy(*by).agg(start.alias("_s"), end.alias("_e")).where("_s IS NOT NULL AND _e IS NOT NULL")
    return out.withColumn("wall_s", F.greatest(F.lit(0.0), (F.col("_e") - F.col("_s")).cast("double"))).drop("_s", "_e")


def stage_marks(snapshots: DataFrame, stages: list[str], at: str = "at", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Starts and ends of stages from snapshots with a report column for each: the first without a report starts, one with a report ends."""
    active, rows = None, []
    for s in stages:
        has = F.coalesce(F.col(s), F.lit("")) != ""
        first = ~has if active is None else ~has & ~active
        active = ~has if active is None else active | ~has
        rows.append(F.when(has, F.array(F.struct(F.lit(s).alias("stage"), F.lit("start").alias("kind")), F.struct(F.lit(s).alias("stage"), F.lit("end").alias("kind")))).when(first, F.array(F.struct(F.lit(s).alias("stage"), F.lit("start").alias("kind")))).otherwise(F.array().cast("array<struct<stage:string,kind:string>>")))
    return snapshots.select(*by, F.col(at).alias("at"), F.inline(F.flatten(F.array(*rows))))


def stage_status(reports: DataFrame, stages: list[str], by: tuple[str, ...] = ("run",)) -> DataFrame:
    """completed with a report, in_progress for the first without one, pending after it."""
    active, out = None, []
    for s in stages:
        has = F.coalesce(F.col(s), F.lit("")) != ""
        status = F.when(has, "completed").when(F.lit(True) if active is None else ~active, "in_progress").otherwise("pending")
        active = ~has if active is None else active | ~has
        out.append(F.struct(F.lit(s).alias("stage"), status.alias("status")))
    return reports.select(*by, F.inline(F.array(*out)))


def progress(status: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """completed and stages of each run, from rows of stage_status."""
    return status.groupBy(*by).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("stages"))


def newest(messages: DataFrame, order: list[str], most: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest messages, as a buffer of bounded length keeps them: one for all, or one for each key."""
    last = [F.col(c).desc() for c in order]
    if not by:
        return messages.orderBy(*last).limit(most)
    return messages.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*last))).where(F.col("_rank") <= most).drop("_rank")


def counters(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Calls, tool uses and tokens in and out (columns kind, tokens_in, tokens_out)."""
    return events.groupBy(*by).agg(
        F.count_if(F.col("kind") == "llm").alias("calls"), F.count_if(F.col("kind") == "tool").alias("tools"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out")
    )


def transcript(turns: DataFrame, by: str, order: str, speaker: str, text: str) -> DataFrame:
    """One text for each thread: its turns in order, a line each."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.concat_ws(": ", speaker, text).alias("v"))))
    return turns.groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["v"]), "\n").alias("transcript"))


def debate_turns(rounds: int, speakers: tuple[str, ...] = ("Bull", "Bear")) -> list[str]:
    """Who speaks when: every speaker once a round."""
    return [speakers[i % len(speakers)] for i in range(rounds * len(speakers))]


def execution_plan(selected: list[str], known: tuple[str, ...] = ("market", "social", "news", "fundamentals"), asset: str = "stock") -> list[str]:
    """The stages to run; an unknown or empty choice is an error, and crypto has no fundamentals."""
    unknown = [s for s in selected if s not in known]
    if unknown:
        raise ValueError(f"unknown stages {unknown}")
    plan = [s for s in selected if not (asset == "crypto" and s == "fundamentals")]
    if not plan:
        raise ValueError("at least one stage must be selected")
    return plan
