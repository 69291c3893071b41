"""The decision log as a table in key ranges, changed batch by batch.

A row belongs to a range by its key: the first characters of its date (a year, a month or a day) and a bucket
of its symbol. A batch reads and rewrites only the ranges of the keys in it; the files of all others stay as they are. What a range
consists of is in a manifest, one small entry for each range. A batch ends by creating the next
manifest under its number, which fails if another writer has done so before; readers see the log before the batch or after
it. The number of the last batch is in the manifest too, so a batch that is tried again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision_log
from .commits import Commits, Conflict

SCHEMA = "date string, symbol string, rating string, pending boolean, raw double, alpha double, holding int, decision string, reflection string, seq bigint"
RANGE = "_range"


class LogTable:
    """The log at ``path``.

    chars: characters of a date that name a range (7: a month); buckets: parts of such a range by symbol, for dates with very many
    entries. Both are fixed when the log is made.
    """

    def __init__(self, spark: SparkSession, path: str, chars: int = 7, buckets: int = 1):
        self.spark, self.path = spark, path
        self.commits = Commits(spark, path)
        if self.commits.newest() is None:
            self.commits.commit({"number": 0, "batch": -1, "seq": -1, "chars": chars, "buckets": buckets, "ranges": {}})

    def manifest(self) -> dict:
        """number, batch, seq, chars, buckets, and for each range its folder and how many rows it has."""
        return self.commits.read()

    def range_of(self, manifest: dict) -> Column:
        """The range of a row."""
        day = F.regexp_replace(F.substr(F.coalesce("date", F.lit("")), F.lit(1), F.lit(manifest["chars"])), "[^0-9A-Za-z-]", "_")
        return F.concat(day, F.lit("."), F.pmod(F.xxhash64("symbol"), F.lit(manifest["buckets"])).cast("string"))

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The log, or its entries with dates from first to last: ranges outside aren't opened."""
        m = self.manifest()
        names = [r for r in m["ranges"] if (first is None or r.split(".")[0] >= first[: m["chars"]]) and (last is None or r.split(".")[0] <= last[: m["chars"]])]
        rows = self._rows(m, names)
        rows = rows if first is None else rows.where(F.col("date") >= first)
        return rows if last is None else rows.where(F.col("date") <= last)

    def _rows(self, manifest: dict, ranges: list[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['ranges'][r]['folder']}/{RANGE}={r}" for r in ranges]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _rewrite(self, manifest: dict, touched: list[str], rows: DataFrame, **changes) -> None:
        """Replaces the touched ranges by the rows and commits."""
        folder = f"data/{manifest['number'] + 1:012d}-{uuid.uuid4().hex}"
        ranges = {r: v for r, v in manifest["ranges"].items() if r not in touched}
        if touched:
            named = rows.withColumn(RANGE, self.range_of(manifest))
            named.repartition(RANGE).sortWithinPartitions(RANGE, "seq").write.partitionBy(RANGE).parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(f"{SCHEMA}, {RANGE} string").parquet(f"{self.path}/{folder}")
            found = written.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"), F.count_if("pending").alias("pending"), F.max("seq").alias("seq")).collect()  # a row for each touched range
            ranges |= {r[RANGE]: {"folder": folder, "rows": r["rows"], "pending": r["pending"]} for r in found}
            changes["seq"] = max([manifest["seq"], *(r["seq"] for r in found)])
        self.commits.commit({**manifest, "number": manifest["number"] + 1, "ranges": ranges, **changes})

    def apply(self, batch: int, new: DataFrame | None = None, updates: DataFrame | None = None) -> bool:
        """Appends pending entries (date, symbol, rating, decision), then sets outcomes (date, symbol, raw, alpha, holding, reflection); false if this batch or a later one was applied before.

        The meaning is that of :func:`decision_log.append_pending` and :func:`decision_log.resolve` on the whole log: a key's entries are all in one range. Batches are
        numbered in ascending order by one writer; a second one gets :class:`Conflict`.
        """
        m = self.manifest()
        if batch <= m["batch"]:
            return False
        asked = [df.select(self.range_of(m).alias(RANGE)) for df in (new, updates) if df is not None]
        keys = asked[0].unionByName(asked[1]) if len(asked) > 1 else asked[0] if asked else None
        touched = sorted(r[RANGE] for r in keys.distinct().collect()) if keys is not None else []
        rows = self._rows(m, [r for r in touched if r in m["ranges"]])
        if new is not None:
            rows = decision_log.append_pending(rows, new, m["seq"])
        if updates is not None:
            rows = decision_log.resolve(rows, updates)
        self._rewrite(m, touched, rows, batch=batch)
        return True

    def load(self, log: DataFrame) -> None:
        """Replaces the whole log by the given one (its columns and types are those of SCHEMA)."""
        m = self.manifest()
        kinds = self.spark.createDataFrame([], SCHEMA).schema
        rows = log.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
        self._rewrite({**m, "ranges": {}}, ["all"], rows)

    def rotate(self, most: int | None) -> None:
        """Drops the oldest resolved entries beyond ``most``, by seq; ranges without such entries aren't rewritten. Pending entries stay."""
        m = self.manifest()
        resolved = sum(v["rows"] - v["pending"] for v in m["ranges"].values())
        if not most or most <= 0 or resolved <= most:
            return
        done = self.read().where("NOT pending").select("date", "symbol", "seq")
        bound = done.orderBy(F.col("seq").desc()).limit(most).agg(F.min("seq")).first()[0]
        touched = sorted(r[RANGE] for r in done.where(F.col("seq") < bound).select(self.range_of(m).alias(RANGE)).distinct().collect())
        self._rewrite(m, touched, self._rows(m, touched).where(F.col("pending") | (F.col("seq") >= bound)))

    def vacuum(self) -> None:
        """Deletes manifests but the newest, and folders that it has nothing in. Not while others read or write."""
        self.commits.vacuum({v["folder"].split("/")[1] for v in self.manifest()["ranges"].values()})

    def sink(self, split: Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: split gives the new entries and the outcomes in a batch's rows."""

        def write(rows: DataFrame, batch: int) -> None:
            if batch <= self.manifest()["batch"]:
                return
            kept = rows.persist()
            try:
                self.apply(batch, *split(kept))
            finally:
                kept.unpersist()

        return write


__all__ = ["Conflict", "LogTable", "SCHEMA"]
