"""Exact duplicates by a persistent index of digests.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the text, in a partition for
each batch that was added. A row of it stands for one digest in one batch: the copies there, the
largest id among them, and whether the digest was new. A batch is reduced to its distinct digests,
written in buckets, and met with the index by sort-merge joins that shuffle neither side: the
anti-join gives the digests that no earlier batch has. Both the new and the known ones are then
appended. A batch has a name; adding it again replaces its own rows, so a repeated job changes
nothing.

Two texts are equal if their UTF-8 bytes have one SHA-256; no shorter hash decides anything.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

#: At most so many frequent digests are broadcast (some 80 bytes each).
HOT_DIGESTS = 1 << 17
#: Digests with fewer copies than this are never treated as frequent.
HOT_COPIES = 64
_COLUMNS = "digest binary, doc_id bigint, copies bigint, fresh boolean, batch int"


def digests(documents: DataFrame, normalise: Column | None = None) -> DataFrame:
    """doc_id and digest of every row; a null text counts as empty. normalise: what texts are compared by, the text itself if not given."""
    text = F.coalesce(F.col("text") if normalise is None else normalise, F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """The index at ``path``; it is made there if there is none.

    buckets: how many files a batch has, fixed when the index is made (at 100 TB so many that a bucket
    fits a task); a later session reads it from the folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._layout(buckets)
        self.table = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        self._register(self.table, f"{path}/rows")
        self._register(self._staged, f"{path}/staged")

    @property
    def _staged(self) -> str:
        return self.table + "_staged"

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets, as the folder has it."""
        at = f"{self.path}/layout"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(n).alias("buckets")).write.parquet(at)
        return self.spark.read.parquet(at).first()["buckets"]

    def _register(self, table: str, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_COLUMNS}) USING parquet OPTIONS (path '{path}', compression 'zstd') PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        """Replaces the batch's partition, in buckets."""
        dealt = df.repartition(self.buckets, "digest")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            dealt.select("digest", "doc_id", "copies", "fresh", F.lit(batch).alias("batch")).write.mode("overwrite").insertInto(table)
        finally:
            self.spark.conf.set(mode, before)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Appends the digests of a batch (doc_id, digest); returns those that no other batch has, with the id that stands for each.

        Of the copies within a batch that with the largest id stands for them, one with an id before
        any without. An empty batch appends nothing.
        """
        found = rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.lit(True).alias("fresh"))
        self._write(found, self._staged, batch)
        staged = self.spark.table(self._staged).where(F.col("batch") == batch)
        before = self.rows().where((F.col("batch") != batch) & F.col("fresh")).select("digest")
        fresh = staged.join(before.hint("merge"), "digest", "left_anti")
        known = staged.join(before.hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))
        self._write(fresh.unionByName(known), self.table, batch)
        self.spark.sql(f"ALTER TABLE {self._staged} DROP IF EXISTS PARTITION (batch = {batch})")
        Scratch.at(self.spark, self.path).drop(f"staged/batch={batch}")
        return self.rows().where((F.col("batch") == batch) & F.col("fresh")).select("digest", "doc_id")

    def groups(self) -> DataFrame:
        """digest, keep_id (of its copy that came first, by batches) and group_size (its copies in all batches); no shuffle."""
        return self.rows().groupBy("digest").agg(F.max(F.when(F.col("fresh"), F.col("doc_id"))).alias("keep_id"), F.sum("copies").alias("group_size"))

    def look_up(self, rows: DataFrame) -> DataFrame:
        """The rows (with a digest) and keep_id and group_size of each.

        A digest with very many copies would be one task of the join. Digests with at least a share of
        1 in HOT_DIGESTS of all copies are at most HOT_DIGESTS, whatever the texts are, so these are broadcast;
        the others meet the index in a sort-merge join, with fewer rows of any digest than that share.
        """
        total = self.rows().agg(F.sum("copies")).first()[0] or 0
        bound = max(HOT_COPIES, -(-total // HOT_DIGESTS))
        groups = self.groups()
        hot = F.broadcast(groups.where(F.col("group_size") >= bound))
        rare = groups.where(F.col("group_size") < bound)
        often = rows.join(hot, "digest")
        return often.unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(rare.hint("merge"), "digest"))


def exact_duplicates(documents: DataFrame, arrivals: int = 3, normalise: Column | None = None, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``documents`` (doc_id, text; other columns are ignored).

    Of equal texts the row with the largest doc_id stays. The table is added to a new index in ``arrivals`` batches
    by ranges of the id, the largest ids first, so what came first is what stays: each batch is an anti-join
    with what has been seen, as it would be for data of later days. A null text counts as empty. Rows
    with a null doc_id come last: they go if their text has a row with an id, and stay (keep_id null)
    if it has none. Rows with one id and one text are one document: they stay or go together, each counts in group_size. An
    empty table gives an empty table.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "exact")
    rows = scratch.save(digests(documents, normalise), "digests")
    index = index or DigestIndex(spark, f"{scratch.path}/index")
    cuts = rows.approxQuantile("doc_id", [k / arrivals for k in range(1, arrivals)], 0.01) if arrivals > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for k, (low, high) in enumerate(reversed(list(zip(edges[:-1], edges[1:], strict=True)))):
        part = rows.where(F.lit(True) if high is None else F.coalesce(F.col("doc_id") <= high, F.lit(True)))
        index.add(part if low is None else part.where(F.col("doc_id") > low), k)
    found = index.look_up(rows)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
