"""Shards whose mixture of sources is that of the corpus: proportional stratified interleaving.

1. Within each source the rows are put in a seeded pseudo-random order and ranked.
2. A row's fractional rank is ``(rank - 1/2) / rows of its source``, so every source is
   spread evenly over the interval from 0 to 1.
3. All rows are ordered by fractional rank and cut into runs whose lengths differ by one
   at most. Each run then holds every source in proportion, up to one row and
   the source's share of as many rows as there are sources.

No source and no run is ever ranked in one task. Ranks come from two steps: rows are dealt
to buckets of the ordering key, each bucket is ranked by itself, and the counts of the
buckets before it are added. The buckets are equal slices of the (uniform) key, and their
number follows the row count, so a source that holds a third of all rows fills many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a bucket holds on average.
BUCKET_ROWS = 512


def _ranked(rows: DataFrame, within: list[str], bucket: str, order: list, rank: str) -> DataFrame:
    """Adds the 1-based rank of each row in ``within`` (all rows if that is empty), ordered by bucket, then by ``order``; with ``within`` also its rows, ``_n``.

    The widest window is over the blocks of one source: the root of its buckets' number.
    """
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_in"))
    # Sums over blocks of buckets first, so that no window sees all buckets, whatever share of the rows one source holds.
    counts = counts.withColumn("_block", F.floor(F.sqrt(F.col(bucket).cast("double"))))
    blocks = counts.groupBy(*within, "_block").agg(F.sum("_in").alias("_sum"))
    every = W.partitionBy(*within)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_sum").over(every.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("_n", F.sum("_sum").over(every)).drop("_sum")
    inside = W.partitionBy(*within, "_block").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_own", F.coalesce(F.sum("_in").over(inside), F.lit(0))).join(blocks, [*within, "_block"])
    counts = counts.withColumn("_before", F.col("_ahead") + F.col("_own"))
    keys = [*within, bucket]
    placed = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn(rank, F.row_number().over(placed))
    added = ["_before", "_n"] if within else ["_before"]
    return rows.join(counts.select(*keys, *added), keys).withColumn(rank, F.col(rank) + F.col("_before")).drop("_before")


def interleave(rows: DataFrame, shards: int = 16, source: str | Column = "source", key: str | Column = "doc_id", seed: int = 17, tie: tuple = ()) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps in each shard).

    source: a null source is a source of its own. key: what the seeded shuffle hashes; rows
    with equal keys are ordered by the columns in ``tie``, and rows that are equal in all of
    them are interchangeable. Shard sizes differ by one row at most. An empty table gives an
    empty table. The added columns replace any of the same names.
    """
    source = F.col(source) if isinstance(source, str) else source
    key = F.col(key) if isinstance(key, str) else key
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))
    rows = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    uniform = F.shiftright("_h", 10) / F.lit(float(1 << 53))
    buckets = F.ceil(F.col("_all") / BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.floor(uniform * buckets))
    rows = _ranked(rows, ["_source"], "_bucket", ["_h", *tie], "_rank").drop("_bucket")
    fraction = (F.col("_rank") - 0.5) / F.col("_n")
    rows = rows.withColumn("_fraction", fraction)
    rows = rows.withColumn("_bucket", F.floor(F.col("_fraction") * buckets))
    rows = _ranked(rows, [], "_bucket", ["_fraction", "_source", "_h", *tie], "_place").drop("_bucket")
    place = F.col("_place") - 1
    # The first place of shard s is ceil(s * all / shards).
    rows = rows.withColumn("shard", F.expr(f"int((_place - 1) * {shards} div _all)"))
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return rows.withColumn("slot", (place - first).cast("long")).drop("_source", "_h", "_n", "_all", "_rank", "_fraction", "_place")


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, under the law ``rows``.

    The text is reduced to its size and checksum in the scan; it is never shuffled. A null text
    has size 1 and checksum 0. A null source is a source of its own. Rows with a null doc_id are
    dealt like others, in the order of their size and checksum. Repeated rows each get a place;
    an empty table gives an empty table. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = interleave(rows, shards, seed=seed, tie=("doc_id", "size", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
