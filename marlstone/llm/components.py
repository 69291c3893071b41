"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and a join back to the links, so
no component and no list of neighbours is ever held in one place. A node with very many links
is a skewed join key: the minima, one row for each node, are broadcast where the counted links
bound their number, and written as a table elsewhere, so that adaptive execution can split the
key. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Row count up to which an id table may be broadcast (some 16 MB).
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) of every node that has a link (columns a, b: long)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    state, step, n = None, 0, edges.count()

    def with_least(links: DataFrame, low: DataFrame, k: str) -> DataFrame:
        """Links with the minimum ``m`` of their u; there are at most two nodes for each link."""
        return links.join(F.broadcast(low) if 2 * n <= BROADCAST_ROWS else scratch.save(low, f"{name}-{k}"), "u")

    while True:
        # Large star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both, low, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = with_least(large, low, "least")
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        new = scratch.save(new, f"{name}-{step}")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}", f"{name}-large", f"{name}-least")
        edges, n = new, seen[0]
        if seen == state:
            break
        state = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
