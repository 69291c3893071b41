"""Tables and files that outlive an executor, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset (tests on
one machine) a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI of the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir() + "/marlstone-checkpoints"
    return folder if ":" in folder else f"file://{folder}"


class Scratch:
    """A new folder in the shared one, for the tables and files of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Scratch:
        """A folder that is there already."""
        found = cls.__new__(cls)
        found.spark, found.path = spark, path
        return found

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as a table and returns it as read from there: its lineage ends here."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
