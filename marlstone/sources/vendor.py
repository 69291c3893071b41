"""Daily bars of a vendor as a data source: ``spark.read.format("vendor_bars")`` and ``spark.readStream``.

A client fetches the answer for one symbol and one month; which client is an option, so any vendor can be
added. The scan has a partition for some symbols and a range of months, bounds on symbol and date are pushed into it, and answers that fall outside
aren't asked for. A rate-limited answer is asked for again, after growing pauses, by the task that reads it. As a
stream, the offset is the newest date that the vendor has: a batch reads the days since the one before.

Options: ``client`` (module:Class, else recorded answers), ``path`` (what the client is made with), ``symbols`` (separated by commas, else all that the client
has), ``start`` and ``end`` (months, both included), ``per_task`` (symbols of one partition; without it, recorded answers are read by the file), ``retries`` and ``pause`` (seconds before the first one).
"""

from __future__ import annotations

import csv
import datetime as dt
import importlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..errors import NoData, RateLimited
from .routing import with_backoff

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume"))])
_DAY = dt.timedelta(1)
#: Files that recorded answers are dealt to, by symbol; rows of a batch.
BUCKETS, ROWS = 128, 1 << 13


class RecordedAnswers:
    """Answers kept in a folder that all executors reach, many to a file, as :func:`record` writes them: ``bucket=K/*.parquet`` (symbol, month, last, text) holds all
    answers of the symbols of a bucket. A bucket is read once, for all that is asked of it in a row.
    """

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        self._held: tuple[int, dict[str, dict[str, list[str]]]] = (-1, {})

    def _files(self, bucket: int | None = None) -> list[str]:
        folder = self.path if bucket is None else f"{self.path}/bucket={bucket}"
        found = self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=bucket is None))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet"))

    def _answers(self, bucket: int) -> dict[str, dict[str, list[str]]]:
        """symbol -> month -> texts, both in order."""
        if self._held[0] != bucket:
            found: dict[str, dict[str, list[str]]] = {}
            for path in self._files(bucket):
                with self.fs.open_input_file(path) as source:
                    rows = pq.ParquetFile(source).read(columns=["symbol", "month", "text"])
                for symbol, month, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    found.setdefault(symbol, {}).setdefault(month, []).append(text)
            self._held = bucket, {s: dict(sorted(found[s].items())) for s in sorted(found)}
        return self._held[1]

    def places(self) -> list[int]:
        """Buckets that hold answers."""
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(n) for f in found if f.type == pafs.FileType.Directory and (n := f.base_name.removeprefix("bucket=")).isdigit())

    def symbols(self, place: int | None = None) -> list[str]:
        """Those of a bucket, or all."""
        return [s for k in (self.places() if place is None else [place]) for s in self._answers(k)]

    def months(self, symbol: str) -> list[str]:
        return list(self._answers(_bucket(symbol)).get(symbol, {}))

    def newest(self) -> str:
        """The newest date of any symbol, '' without answers: from the files' statistics."""
        top = ""
        for path in self._files():
            with self.fs.open_input_file(path) as source:
                data = pq.ParquetFile(source).metadata
            at = data.schema.names.index("last")
            top = max([top, *(data.row_group(k).column(at).statistics.max for k in range(data.num_row_groups) if data.row_group(k).num_rows)])
        return top

    def fetch(self, symbol: str, month: str) -> str:
        """The answer as CSV with a header."""
        texts = self._answers(_bucket(symbol)).get(symbol, {}).get(month)
        if not texts:
            raise NoData(symbol, detail=f"nothing for {month}")
        return texts[0] + "".join(t.split("\n", 1)[1] for t in texts[1:])


def _bucket(symbol: str) -> int:
    return zlib.crc32(symbol.encode()) % BUCKETS


def record(bars: DataFrame, path: str) -> None:
    """Writes bars as recorded answers, a text for each symbol and month, a file for each bucket of symbols. Bars without a symbol or date can't be asked for and are left out."""
    values = ("open", "high", "low", "close", "volume")
    rows = bars.where("symbol IS NOT NULL AND date IS NOT NULL").select("symbol", F.date_format("date", "yyyy-MM").alias("month"), F.date_format("date", "yyyy-MM-dd").alias("date"), *values)
    # A month's bars of one symbol: few.
    lines = F.array_sort(F.collect_list(F.struct("date", F.to_csv(F.struct("date", *values)).alias("line"))))
    answers = rows.groupBy("symbol", "month").agg(F.max("date").alias("last"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    answers = answers.withColumn("text", F.concat(F.lit(",".join(("date", *values)) + "\n"), "text", F.lit("\n"))).withColumn("bucket", (F.crc32(F.col("symbol").cast("binary")) % BUCKETS).cast("int"))
    answers.repartition("bucket").sortWithinPartitions("bucket", "symbol", "month").write.mode("append").partitionBy("bucket").parquet(path)


@dataclass
class Asked(InputPartition):
    """Months of some symbols (all of a place, where one is named), and the days that count."""

    symbols: tuple[str, ...]
    first: str
    last: str
    low: dt.date
    high: dt.date
    place: int | None = None


class _Answers:
    """What both readers share."""

    def __init__(self, options: dict):
        self.options = options
        self.names: set[str] | None = {s.strip() for s in options["symbols"].split(",") if s.strip()} if options.get("symbols") else None
        self.low, self.high = dt.date.min, dt.date.max
        if options.get("start"):
            self.low = dt.date.fromisoformat(options["start"][:7] + "-01")
        if options.get("end"):
            self.high = (dt.date.fromisoformat(options["end"][:7] + "-01") + dt.timedelta(31)).replace(day=1) - _DAY

    def client(self):
        module, _, name = self.options.get("client", f"{__name__}:RecordedAnswers").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def asked(self, low: dt.date, high: dt.date) -> list[Asked]:
        """Partitions of so many symbols each; none without a symbol or a day. All symbols of a client that has places, and no ``per_task``: a partition for each place, whose task lists its symbols."""
        low, high = max(low, self.low), min(high, self.high)
        if low > high:
            return []
        client, days = self.client(), (f"{low:%Y-%m}" if low.year > 1 else "", f"{high:%Y-%m}", low, high)
        if self.names is None and "per_task" not in self.options and hasattr(client, "places"):
            return [Asked((), *days, place) for place in client.places()]
        names = sorted(client.symbols() if self.names is None else self.names)
        size = int(self.options.get("per_task", 16))
        return [Asked(tuple(names[k : k + size]), *days) for k in range(0, len(names), size)]

    def read(self, part: Asked | None) -> Iterator[pa.RecordBatch]:
        """Batches of the rows of some answers; a symbol or month without rows gives none. A limit that stays is an error. A scan without partitions comes as one that is None."""
        if part is None:
            return
        client = self.client()
        retries, pause = int(self.options.get("retries", 3)), float(self.options.get("pause", 2.0))
        names: list[str] = []
        rows: list[tuple[dt.date, dict]] = []

        def batch() -> pa.RecordBatch:
            columns = [names, [d for d, _ in rows], *([float(r[c]) if r[c] else None for _, r in rows] for c in ("open", "high", "low", "close", "volume"))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for symbol in part.symbols if part.place is None else client.symbols(part.place):
            for month in client.months(symbol):
                if not part.first <= month <= part.last:
                    continue
                try:
                    text = with_backoff(lambda s=symbol, m=month: client.fetch(s, m), retries, pause)
                except NoData:
                    continue
                found = [(d, r) for r in csv.DictReader(io.StringIO(text)) if part.low <= (d := dt.date.fromisoformat(r["date"])) <= part.high]
                rows += found
                names += [symbol] * len(found)
                if len(rows) >= ROWS:
                    yield batch()
                    names, rows = [], []
        if rows:
            yield batch()


class _Reader(_Answers, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds on symbol and date; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = found if self.names is None else self.names & found
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("date",) and isinstance(f.value, dt.date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + _DAY if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - _DAY if isinstance(f, LessThan) else f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute in (("symbol",), ("date",))):  # neither is ever null
                yield f

    def partitions(self) -> list[Asked]:
        return self.asked(self.low, self.high)


class _StreamReader(_Answers, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"date": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"date": self.client().newest()}

    def partitions(self, start: dict, end: dict) -> list[Asked]:
        if not end["date"] or start["date"] >= end["date"]:
            return []
        return self.asked(dt.date.fromisoformat(start["date"]) + _DAY if start["date"] else dt.date.min, dt.date.fromisoformat(end["date"]))

    def commit(self, end: dict) -> None:
        pass


class VendorBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def use_vendor(spark: SparkSession) -> None:
    """Makes the source known to the session, with bounds pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)


__all__ = ["RateLimited", "RecordedAnswers", "VendorBars", "record", "use_vendor"]
