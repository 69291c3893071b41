"""Numbered manifests: what a table consists of, changed by one atomic step at a time."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


class Commits:
    """The manifests below ``path``: small JSON files with ascending numbers, the greatest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path, spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self.at("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def newest(self) -> int | None:
        if not self._fs.exists(self.at("manifests")):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self.at("manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def read(self) -> dict:
        stream = self._fs.open(self.at(f"manifests/{self.newest():012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Creates the manifest under its number, at once and only if there is none."""
        temporary, final = self.at(f"manifests/.{uuid.uuid4().hex}"), self.at(f"manifests/{manifest['number']:012d}")
        out = self._fs.create(temporary, True)
        out.writeBytes(json.dumps(manifest))
        out.close()
        none = self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(temporary, final, none)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"commit {manifest['number']} of {self.path} is there already") from e
            raise

    def vacuum(self, used: set[str]) -> None:
        """Deletes manifests but the newest, and folders of ``data`` that aren't in use. Not while others read or write."""
        newest = f"{self.newest():012d}"
        for folder, kept in (("manifests", {newest}), ("data", used)):
            if self._fs.exists(self.at(folder)):
                for status in self._fs.listStatus(self.at(folder)):
                    if status.getPath().getName() not in kept:
                        self._fs.delete(status.getPath(), True)
