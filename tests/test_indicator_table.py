"""Indicators kept up to date, against a full run over all bars."""

import datetime as dt
import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from marlstone.operators import indicators
from marlstone.sources.indicator_table import BARS, NAMES, IndicatorTable

D0 = dt.date(2023, 1, 1)


def market(n=260, seed=2):
    """Symbols that trade on all days, on some, only early and only late."""
    r, rows = random.Random(seed), []
    for symbol, often in (("a", 1.0), ("b", 0.4), ("early", 1.0), ("late", 1.0)):
        for i in range(n):
            if r.random() < often and not (symbol == "early" and i > 60) and not (symbol == "late" and i < n - 12):
                c = 100 + 15 * math.sin(i / 9) + r.random()
                rows.append((symbol, D0 + dt.timedelta(i), c, c + r.random(), c - r.random(), c + r.random() - 0.5, float(r.randint(1, 99))))
    return rows


def same(spark, table, rows):
    df = spark.createDataFrame(rows, BARS)
    key = lambda d: {(r["symbol"], r["date"]): [None if r[c] is None else round(r[c], 6) for c in ("close", *NAMES)] for r in d.collect()}
    got, want = key(table.read()), key(indicators.with_indicators(df, NAMES))
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def of(rows, low, high):
    return [x for x in rows if low <= (x[1] - D0).days < high]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "_day=" in str(p)}


def test_day_by_day_and_corrections(spark, tmp_path):
    rows = market()
    table = IndicatorTable(spark, f"file://{tmp_path}/t")
    table.update(spark.createDataFrame(of(rows, 0, 255), BARS))
    before = files(tmp_path)
    for day in range(255, 258):
        assert IndicatorTable(spark, f"file://{tmp_path}/t").update(spark.createDataFrame(of(rows, day, day + 1), BARS)) == [(D0 + dt.timedelta(day)).isoformat()]
    # A new day touches no file of an earlier one.
    assert before.items() <= files(tmp_path).items()
    same(spark, table, of(rows, 0, 258))
    # A correction of a close, and a bar that was missing; days before the last carry before it stay as they are.
    late = [(s, d, o, h, lo, c + 5, v) for s, d, o, h, lo, c, v in of(rows, 256, 257) if s == "a"] + [("new", D0 + dt.timedelta(256), 1.0, 2.0, 0.5, 1.5, 3.0)]
    written = table.update(spark.createDataFrame(late, BARS))
    assert written[0] == (D0 + dt.timedelta(256)).isoformat() and before.items() <= files(tmp_path).items()
    fixed = [x for x in of(rows, 0, 258) if not (x[0] == "a" and x[1] == D0 + dt.timedelta(256))] + late
    same(spark, table, fixed)
    # The same again changes nothing; an early one computes everything anew.
    table.update(spark.createDataFrame(late, BARS))
    same(spark, table, fixed)
    early = [("b", D0 + dt.timedelta(3), 9.0, 9.5, 8.0, 9.2, 4.0)]
    table.update(spark.createDataFrame(early, BARS))
    fixed = [x for x in fixed if not (x[0] == "b" and x[1] == D0 + dt.timedelta(3))] + early
    table.update(spark.createDataFrame(of(rows, 258, 260), BARS))
    same(spark, table, fixed + of(rows, 258, 260))
    table.vacuum()
    same(spark, table, fixed + of(rows, 258, 260))
    assert table.update(spark.createDataFrame([], BARS)) == []
    day = (D0 + dt.timedelta(259)).isoformat()
    assert table.read(day, day).agg(F.min("date"), F.max("date")).first()[:] == (D0 + dt.timedelta(259),) * 2
