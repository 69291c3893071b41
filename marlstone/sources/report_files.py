"""Reports of many runs as files, written by the executors.

Texts are made as columns, a row for each file (run, path, text), and written by a data source: tasks write to the folder of a new version, and
one pointer, replaced at the end of the job, makes it part of the tree. A job that fails deletes its folder; what a task that was still running has
written after that is in no version, so nobody reads it, and :func:`vacuum` deletes it. Each task lists its files in one more, and the version names the lists
that count, so readers need no listing of folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import NoData

FILES = "run string, path string, text string"
POINTER = "_versions"
#: Of a version: the lists of its tasks. Files that a task reads, and bytes of a batch, about.
LISTS, TASK_FILES, BATCH_BYTES = ".lists", 1 << 11, 1 << 22


def tree_rows(states: DataFrame, sections: dict[str, dict[str, str]], title: str = "Report") -> DataFrame:
    """Files of each run (column ``run``): one for each part that has text, ``1_section/part.md``, and ``complete_report.md`` with all of them if there are any.

    sections: section -> part -> column; sections are numbered as they stand here, whether they have text or not.
    """
    parts, chapters = [], []
    file = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
    for n, (section, columns) in enumerate(sections.items(), 1):
        there = {part: F.trim(F.coalesce(F.col(c), F.lit("")), F.lit(" \n\t\r")) != "" for part, c in columns.items()}
        texts = [F.when(there[p], F.concat(F.lit(f"### {p}\n\n"), F.col(c), F.lit("\n"))) for p, c in columns.items()]
        parts += [F.when(there[p], file(f"{n}_{section}/{p}.md", F.col(c))) for p, c in columns.items()]
        body = F.array_join(F.array_compact(F.array(*texts)), "\n")
        chapters.append(F.when(body != "", F.concat(F.lit(f"## {n}. {section}\n\n"), body)))
    whole = F.array_join(F.array_compact(F.array(*chapters)), "\n")
    parts.append(F.when(whole != "", file("complete_report.md", F.concat(F.lit(f"# {title}: "), F.col("run").cast("string"), F.lit("\n\n"), whole))))
    return states.select(F.col("run").cast("string").alias("run"), F.inline(F.array_compact(F.array(*parts))))


def state_rows(states: DataFrame, path: str = "state.json") -> DataFrame:
    """The whole state of each run as one JSON file; columns without a value are left out."""
    rest = [c for c in states.columns if c != "run"]
    return states.select(F.col("run").cast("string").alias("run"), F.lit(path).alias("path"), F.to_json(F.struct("run", *rest)).alias("text"))


def log_rows(messages: DataFrame, order: list[str], line: Column, path: str = "messages.log") -> DataFrame:
    """A log file of each run: a line for each message in order, line feeds inside as blanks. A run's messages make one file, so they are put together in one row."""
    text = F.replace(F.coalesce(line, F.lit("")), F.lit("\n"), F.lit(" "))
    lines = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), text.alias("line"))))
    rows = messages.groupBy(F.col("run").cast("string").alias("run")).agg(F.transform(lines, lambda x: x["line"]).alias("_l"))
    return rows.select("run", F.lit(path).alias("path"), F.concat(F.array_join("_l", "\n"), F.lit("\n")).alias("text"))


def table_rows(df: DataFrame, columns: list[str], order: list[Column], limit: int, path: str = "table.md") -> DataFrame:
    """A Markdown table of the first rows of each run, with a heading of how many there are; no more rows than the limit come together."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in columns]
    w = W.partitionBy("run")
    some = df.select("run", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("_line"), F.row_number().over(w.orderBy(*order)).alias("_k"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_k") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: x["_line"])
    rows = some.groupBy("run").agg(lines.alias("_l"), F.first("_n").alias("_n"))
    head = F.concat(F.lit("Total records: "), F.col("_n").cast("string"), F.lit("\n\n| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"))
    note = F.when(F.col("_n") > limit, F.concat(F.lit(f"\n_({limit} of "), F.col("_n").cast("string"), F.lit(" rows)_\n"))).otherwise("")
    return rows.select(F.col("run").cast("string").alias("run"), F.lit(path).alias("path"), F.concat(head, F.array_join("_l", "\n"), F.lit("\n"), note).alias("text"))


@dataclass
class _Written(WriterCommitMessage):
    files: int
    names: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.uri, self.overwrite, self.version = path if ":" in path else f"file://{path}", overwrite, f"v-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A task that is tried again writes the same files once more."""
        fs, top = self._folder()
        n, made, names = 0, set(), []
        for batch in iterator:
            for run, path, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("run", "path", "text")), strict=True):
                name = f"{run}/{path}"
                if run is None or path is None or any(x in ("", ".", "..") for x in name.split("/")):
                    raise ValueError(f"no path inside the tree: {name}")
                target = f"{top}/{self.version}/{name}"
                if (folder := target.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(target) as out:
                    out.write((text or "").encode())
                names.append(json.dumps([run, path]))
                n += 1
        mine = f".list-{uuid.uuid4().hex}"
        if n:
            with fs.open_output_stream(f"{top}/{self.version}/{mine}") as out:
                out.write("\n".join(names).encode())
        return _Written(n, mine)

    def commit(self, messages: list) -> None:
        """The pointer names the versions that count: this one, and the earlier ones unless they are overwritten."""
        fs, top = self._folder()
        fs.create_dir(f"{top}/{self.version}", recursive=True)
        with fs.open_output_stream(f"{top}/{self.version}/{LISTS}") as out:
            out.write("\n".join(json.dumps([m.files, m.names]) for m in messages if m is not None and m.files).encode())
        before = versions(self.uri)
        temporary = f"{top}/.{self.version}"
        with fs.open_output_stream(temporary) as out:
            out.write("\n".join([*([] if self.overwrite else before), self.version]).encode())
        try:
            fs.move(temporary, f"{top}/{POINTER}")
        except OSError:  # some stores don't rename over a file
            fs.delete_file(f"{top}/{POINTER}")
            fs.move(temporary, f"{top}/{POINTER}")
        for old in before if self.overwrite else []:
            fs.delete_dir(f"{top}/{old}")

    def abort(self, messages: list) -> None:
        fs, top = self._folder()
        if fs.get_file_info(f"{top}/{self.version}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{self.version}")


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def versions(path: str) -> list[str]:
    """The versions that a tree consists of."""
    fs, top = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    if fs.get_file_info(f"{top}/{POINTER}").type != pafs.FileType.File:
        return []
    return [v for v in fs.open_input_stream(f"{top}/{POINTER}").read().decode().split("\n") if v]


def vacuum(path: str) -> None:
    """Deletes folders that are no version. Not while others write."""
    fs, top = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    used = set(versions(path))
    for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and f.base_name.startswith("v-") and f.base_name not in used:
            fs.delete_dir(f.path)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes the files (run, path, text) to the tree at ``path``: all of them, or none if a task fails."""
    rows.sparkSession.dataSource.register(FileTree)
    rows.select(*(F.col(c).cast("string").alias(c) for c in ("run", "path", "text"))).write.format("file_tree").option("path", path).mode(mode).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """run, path and text of all files of the tree; of a file that several versions have, each."""
    found = versions(path)
    if not found:
        raise NoData(path, detail="there is no tree")
    uri = path if ":" in path else f"file://{path}"
    fs, top = pafs.FileSystem.from_uri(uri)
    lists = [(v, *json.loads(x)) for v in found for x in fs.open_input_stream(f"{top}/{v}/{LISTS}").read().decode().split("\n") if x]  # one for each task that wrote
    few = max(1, min(len(lists), spark.sparkContext.defaultParallelism))
    named = spark.createDataFrame(lists, "version string, files long, list string").repartition(few).mapInArrow(_names(uri), "folder string, run string, path string")
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(n for _, n, _ in lists) // TASK_FILES))
    return named.repartition(tasks).mapInArrow(_texts(uri), FILES)


def _names(uri: str):
    """The files of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for version, name in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [json.loads(x) for x in fs.open_input_stream(f"{top}/{version}/{name}").read().decode().split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(rows)), *(pa.array([r[k] for r in rows], pa.string()) for k in range(2))], names=["folder", "run", "path"])

    return run


def _texts(uri: str):
    """The files themselves, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["run", "path", "text"])
        for batch in batches:
            rows, held = [], 0
            for folder, run, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = fs.open_input_stream(f"{top}/{folder}/{run}/{path}").read()
                rows.append((run, path, data.decode()))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    return run
