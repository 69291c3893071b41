"""Runs as one keyed stream: messages once each, the newest in a bounded buffer, stages from pending to completed.

Input rows are snapshots of runs: run, at (timestamp), seq (their order within a run), id and text of a message (id null: never a
repetition; text null: no message) and a column for each stage with its report, if there is one. State is kept for each run until
nothing has come for ``idle``; then its rows are given out and the state goes. Rows of a run are
taken in order within a batch; batches must not go back behind one another.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: kind ``message``: one of the newest, rank 1 the newest; kind ``stage``: rank is its place. n_messages: messages of the run, each id once.
STATE = "run string, kind string, rank int, name string, status string, wall_s double, text string, n_messages long"
#: Messages that a buffer holds.
BUFFER = 100


class _Tracker(StatefulProcessor):
    """What is kept of a run is one value, so a batch reads and writes it once. Ids of a run's first batch stand in it, too, as most runs
    have no other; when more comes they move to a map, where each has its own entry.
    """

    def __init__(self, stages: tuple[str, ...], most: int, idle_ms: int):
        self.stages, self.most, self.idle_ms = stages, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "there boolean")
        # first: ids that are not in the map. has, start_us, end_us by stage: whether the last report that was there has text, and the first start and end.
        self.state = handle.getValueState("run", "messages long, last_ms long, first array<string>, seqs array<long>, ids array<string>, texts array<string>, has array<boolean>, start_us array<long>, end_us array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = sorted(rows, key=lambda r: (r["at_us"], r["seq"] is None, r["seq"] or 0))
        state = self.state.get()
        timer = None if state is None else state[1]
        fresh, part = state is None, []
        last = new[0]["at_us"] // 1000 if state is None else state[1]
        for row in new:
            at = row["at_us"] // 1000
            # A pause of more than the idle time ends a run, whether its timer has come up yet or not.
            if at - last > self.idle_ms:
                if part:
                    state, part = self._added(state, part, fresh), []
                yield from self._rows(key, state)
                if not fresh:
                    self.seen.clear()
                state, fresh = None, True
            part.append(row)
            last = max(last, at)
        state = self._added(state, part, fresh)
        self.state.update(state)
        if timer != state[1]:
            if timer is not None:
                self.handle.deleteTimer(timer + self.idle_ms)
            self.handle.registerTimer(state[1] + self.idle_ms)

    def _added(self, state: tuple | None, rows: list[Row], fresh: bool) -> tuple:
        """The state with some more rows, in order. fresh: the run had no batch before, and no id goes to the map."""
        n = len(self.stages)
        messages, last, first, seqs, ids, texts, has, start, end = state or (0, 0, [], [], [], [], [False] * n, [None] * n, [None] * n)
        buffer, has, start, end = list(zip(seqs, ids, texts, strict=True)), list(has), list(start), list(end)
        if not fresh:
            for name in first:
                self.seen.updateValue((name,), (True,))
            first = []
        known = set(first)
        for row in rows:
            name = row["id"]
            if row["text"] is not None and not (name is not None and (name in known or not fresh and self.seen.containsKey((name,)))):
                if name is not None:
                    known.add(name)
                    if not fresh:
                        self.seen.updateValue((name,), (True,))
                messages += 1
                buffer.append((int(row["seq"]), name, row["text"]))
                buffer = buffer[-self.most :]
            active, at = False, row["at_us"]
            for k, stage in enumerate(self.stages):
                report = row[stage]
                there = report is not None and report != ""
                if there or not active:  # a stage with a report has started and ended, the first without one has started
                    start[k] = at if start[k] is None else min(start[k], at)
                if there:
                    end[k] = at if end[k] is None else min(end[k], at)
                active |= not there
                has[k] = there if report is not None else has[k]
            last = max(last, at // 1000)
        return messages, last, sorted(known) if fresh else [], *([x[k] for x in buffer] for k in range(3)), has, start, end

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The rows of a run, whose state is forgotten."""
        yield from self._rows(key, self.state.get())
        self.seen.clear()
        self.state.clear()

    def _rows(self, key: tuple, state: tuple) -> Iterator[Row]:
        messages, _, _, _, ids, texts, has, start, end = state
        for k, (name, text) in enumerate(reversed(list(zip(ids, texts, strict=True)))):
            yield Row(run=key[0], kind="message", rank=k + 1, name=name, status=None, wall_s=None, text=text, n_messages=messages)
        active = False
        for k, stage in enumerate(self.stages):
            status = "completed" if has[k] else "pending" if active else "in_progress"
            active |= not has[k]
            wall = None if start[k] is None or end[k] is None else max(0.0, (end[k] - start[k]) / 1e6)
            yield Row(run=key[0], kind="stage", rank=k + 1, name=stage, status=status, wall_s=wall, text=None, n_messages=messages)


def run_states(snapshots: DataFrame, stages: list[str], most: int = BUFFER, idle_minutes: int = 60, late: str = "0 seconds") -> DataFrame:
    """The rows of STATE of each run, once it has been idle for so long by event time.

    They are what the batch operators give on the same rows: :func:`news.keep_first_known` and :func:`telemetry.newest` for messages,
    :func:`telemetry.stage_status` over the last reports and :func:`telemetry.wall_times` over :func:`telemetry.stage_marks` for stages. After a
    pause longer than that a run is a new one. Rows without a run or a time are left out. Needs the RocksDB state store.
    """
    rows = snapshots.select(F.col("run").cast("string").alias("run"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"), "text", *stages)
    rows = rows.where("run IS NOT NULL AND at IS NOT NULL").withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("run").transformWithState(_Tracker(tuple(stages), most, idle_minutes * 60_000), STATE, "Append", "EventTime")
