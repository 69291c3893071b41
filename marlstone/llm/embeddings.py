"""Near-duplicate embeddings: all pairs at or above a cosine, by cover trees.

1. Equal vectors are one class with a weight; only classes are compared.
2. A bounded sample gives pivots. Every class goes to the cell of its nearest pivot; a cell with
   too many classes is split by hash, so a crowded region fills several cells, and small cells
   are packed into one.
3. Two cells meet in one task if any of their members can be near enough: a vector is sent to
   meet a cell only if its distance to the cell's pivot is within the cell's radius and the link
   distance, and it stands no further from the plane between the two pivots than that distance.
   Each task builds cover trees of both sides and walks them together.
4. A task returns the weight that each vector links with there, and links enough to connect what
   is connected; no list of all pairs is made. Counts are added up and components formed.

The result is exact. Where vectors have many dimensions and no clusters, no metric bound
separates cells at this distance and every two cells meet, in blocks. So cells are as large as a
task may hold, but for small tables, where there are enough of them for all cores; and blocks are
compared by a bound of a few coordinates first, of which the sample tells how many are enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, small
from .covertree import Links, build, dual, leading_basis
from .neardup import whole_groups
from .storage import Scratch
from .textkernel import keyed


@dataclass(frozen=True)
class Settings:
    """cosine: of a link, at least. cell_rows, cell_bytes: of a cell, at most, about, as doubles. sample: vectors that pivots are chosen from, at
    most; they decide where vectors meet, not which link.
    """

    cosine: float = 0.95
    cell_rows: int = 1 << 17
    cell_bytes: int = 64 << 20
    sample: int = 4096
    most_pivots: int = 1024


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Rows of numbers from vectors kept as bytes of the type they came in."""
    start = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * dim, int(start)).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096].astype(np.float64)
        part /= np.abs(part).max(1, keepdims=True)
        out[at : at + 4096] = part / np.sqrt((part * part).sum(1, keepdims=True))
    return out


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the furthest from those before it."""
    chosen, far = [0], 1 - x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(np.argmax(far))
        if far[k] <= 1e-9:
            break
        chosen.append(k)
        far = np.minimum(far, 1 - x @ x[k])
    return x[chosen]


def _assign(pivots: np.ndarray, dim: int, kind: str):
    """Vectors as bytes, with their cell and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind)
                x = _unit(flat.astype(np.float64).reshape(-1, dim))
                cos = x @ pivots.T
                cell = cos.argmax(1)
                d = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(x)), cell]))
                data = pa.array([v.tobytes() for v in flat.reshape(-1, dim)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], data, pa.array(cell.astype(np.int32)), pa.array(d)], names=["rep", "v1", "weight", "vector", "cell", "distance"])

    return run, "rep long, v1 long, weight long, vector binary, cell int, distance double"


def _numbers(rows: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of so many rows its first number and how many it has: large cells have several, small ones share one."""
    base, parts, used, room = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for k in sorted(range(len(rows)), key=lambda k: rows[k]):
        if rows[k] > room:
            parts[k] = -(-rows[k] // most)
            base[k], used, room = used, used + int(parts[k]), most if parts[k] == 1 else 0
        else:
            base[k] = used - 1
        room -= rows[k] if parts[k] == 1 else 0
    return base, parts


def _meet(pivots: np.ndarray, cells: list[tuple[int, float, int]], most: int, far: float, dim: int, kind: str):
    """Rows for each two (split or packed) cells that a vector has to meet in: key, side, rep, v1, weight, vector."""
    base, parts = _numbers([c[2] for c in cells], most)
    holds = np.zeros((len(cells), int((base + parts).max())), np.float32)
    for k in range(len(cells)):
        holds[k, base[k] : base[k] + parts[k]] = 1
    where = {c[0]: k for k, c in enumerate(cells)}
    centre = pivots[[c[0] for c in cells]]
    radius = np.array([c[1] for c in cells])
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(_matrix(part.column(3), dim, kind))
                k = np.array([where[c] for c in part.column(4).to_pylist()])
                one = np.arange(len(x))
                h = keyed(part.column(0).to_numpy().view(np.uint64) ^ part.column(1).to_numpy().view(np.uint64), 3)
                own = base[k] + (h % parts[k].astype(np.uint64)).astype(np.int64)
                cos = x @ centre.T
                near = np.sqrt(np.maximum(0, 2 - 2 * cos)) <= radius + far + 1e-6
                # A member y of a cell is nearer to its pivot q than to p: (x - y)(p - q) >= x(p - q).
                near &= cos[one, k][:, None] - cos <= far * apart[k] + 1e-6
                near[one, k] = True
                row, other = np.nonzero(near.astype(np.float32) @ holds)
                a, b = np.minimum(own[row], other), np.maximum(own[row], other)
                side = (own[row] > other).astype(np.int8)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(a << 32 | b), pa.array(side), *(part.column(c).take(rows) for c in range(4))], names=["key", "side", "rep", "v1", "weight", "vector"])

    return run, "key long, side byte, rep long, v1 long, weight long, vector binary"


def _walk(cosine: float, dim: int, kind: str, basis: np.ndarray | None):
    """For each vector the weight that it links with here; and links enough to connect those that are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            keys = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                side, rep, v1, weight = (part.column(c).to_numpy() for c in (1, 2, 3, 4))
                key = int(keys[lo])
                inside = key >> 32 == key & 0xFFFFFFFF
                if not inside and (not side.any() or side.all()):
                    continue
                x = _unit(_matrix(part.column(5), dim, kind))
                links = Links(len(x), weight)
                if inside:
                    tree = build(x)
                    dual(x, tree, tree, cosine, links, basis)
                else:
                    dual(x, build(x, np.flatnonzero(side == 0)), build(x, np.flatnonzero(side == 1)), cosine, links, basis)
                some = np.flatnonzero(links.count)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(v1[some]), pa.array(links.count[some]), pa.array(np.full(len(some), None), pa.int64())], names=["rep", "v1", "links", "other"])
                if links.edges:
                    e = np.concatenate(links.edges, axis=1)
                    e = np.stack(np.divmod(np.unique(e[0] * len(x) + e[1]), len(x)))
                    e = e[:, e[0] != e[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[e[1]]), pa.array(v1[e[1]]), pa.array(np.zeros(e.shape[1], np.int64)), pa.array(rep[e[0]])], names=["rep", "v1", "links", "other"])

    return run, "rep long, v1 long, links long, other long"


def near_duplicate_vectors(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding; other columns are ignored).

    n_links: other rows whose vector has a cosine of at least ``settings.cosine`` with the row's,
    equal vectors among them. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, and vectors of different lengths don't link. Rows with the
    same vec_id count as several vectors in n_links and are one in component_id. A row with a
    null vec_id links with nothing, has a null component_id and is kept. An empty table gives an
    empty table.
    """
    s = settings
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    single = isinstance(embeddings.schema["embedding"].dataType, T.ArrayType) and isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType)
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("v1", F.xxhash64("embedding")).withColumn("v2", F.xxhash64(F.lit(7), "embedding"))
    classes = rows.where("valid").groupBy("v1", "v2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes, "classes")
    counts = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}  # lengths of vectors: few
    found = None
    far = float(np.sqrt(2 - 2 * s.cosine))
    at_least = int(np.ceil(np.sqrt(6 * spark.sparkContext.defaultParallelism)))
    for dim, n in sorted(counts.items()):
        own = classes.where(F.size("embedding") == dim).select("rep", "v1", "weight", "embedding")
        most = max(1, min(s.cell_rows, s.cell_bytes // (dim * 8)))
        n_cells = max(-(-n // most), min(at_least, -(-n // 1024)))
        most = -(-n // n_cells)
        sample = own.select("embedding", "rep").orderBy(F.xxhash64(F.lit(11), "rep"), "rep", "v1").limit(s.sample).collect()
        sampled = _unit(np.array([r[0] for r in sample], float))
        pivots, basis = _pivots(sampled, min(s.most_pivots, n_cells)), leading_basis(sampled, s.cosine)
        assigned = scratch.save(own.mapInArrow(*_assign(pivots, dim, kind)), f"assigned-{dim}")
        # One row for each pivot.
        cells = sorted((r["cell"], r["radius"], r["n"]) for r in assigned.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect())
        met = assigned.mapInArrow(*_meet(pivots, cells, most, far, dim, kind)).repartition("key").sortWithinPartitions("key").mapInArrow(*_walk(s.cosine, dim, kind, basis))
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = classes.select("rep", "v1", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("other"))
    found = scratch.save(found, "found")
    # Equal vectors under different ids are linked through their class; several vectors of one id join their classes.
    links = found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    many = rows.where("valid").groupBy("vec_id").agg(F.min("v1").alias("a1"), F.max("v1").alias("b1"), F.min("v2").alias("a2"), F.max("v2").alias("b2")).where("a1 < b1 OR a2 < b2").select("vec_id")
    many = scratch.save(many, "many")
    if n_many := many.count():
        of = rows.where("valid").join(small(many, n_many), "vec_id").select("vec_id", "v1", "v2").join(classes.select("v1", "v2", "rep"), ["v1", "v2"])
        links = links.unionByName(of.join(of.groupBy("vec_id").agg(F.min("rep").alias("a")), "vec_id").select("a", F.col("rep").alias("b")).where("a < b").distinct())
    named = components(links, scratch)
    counted = scratch.save(found.groupBy("rep", "v1").agg(F.sum("links").alias("links")).where("links > 0"), "counted")
    scratch.drop("found", "many", *(f"assigned-{dim}" for dim in counts))
    classes = classes.select("v1", "v2", "rep", "weight").join(counted, ["rep", "v1"], "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("v1", "v2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "valid", "v1", "v2").join(classes, ["v1", "v2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(0).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
