"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled documents, one for each class. A text is
compressed with both, block by block (a dictionary helps most at the start of a frame, so
small blocks keep its effect in long texts; all blocks of the whole text count). The
normalised difference of the two compressed sizes, with how far the text compresses at all,
goes through a logistic calibration fitted on labelled documents that the dictionaries
have not seen.

What is fitted is small (two dictionaries and a few weights) and comes from a bounded sample
of labelled documents, see :class:`Settings`; only texts for the dictionaries come to the driver,
of bounded length. Calibration and scoring read every text as a whole, on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import slices


@dataclass(frozen=True)
class Settings:
    """Bounds of what is fitted, and how."""

    dictionary_docs: int = 1200  #: labelled documents of each class for its dictionary, at most
    calibration_docs: int = 2500  #: further ones of each class for the calibration, at most
    longest_sample: int = 16 << 10  #: bytes of one labelled text for the dictionaries; a longer one gives so many in blocks spread evenly over it (so at most 40 MB come to the driver)
    dictionary_bytes: int = 96 << 10
    block_bytes: int = 2048
    level: int = 1
    threshold: float = 0.7
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    settings: Settings


def held_out(doc_id):
    """Documents that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _dictionary(texts: list[bytes], settings: Settings) -> bytes:
    samples = [b for t in texts for b in _blocks(t, settings.block_bytes)]
    if sum(map(len, samples)) < 4096 or len(samples) < 16:
        return b"".join(samples)[-settings.dictionary_bytes :]
    try:
        return zstandard.train_dictionary(min(settings.dictionary_bytes, sum(map(len, samples)) // 4), samples, level=settings.level).as_bytes()
    except zstandard.ZstdError:  # too little variety for a trained one: a raw one of the newest blocks
        return b"".join(samples)[-settings.dictionary_bytes :]


_FEATURES = 7


class _Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, settings: Settings):
        self.block = settings.block_bytes
        self.pair = []
        for d in (good, bad):
            data = zstandard.ZstdCompressionDict(d) if len(d) >= 8 else None
            if data is not None:
                data.precompute_compress(level=settings.level)
            self.pair.append(zstandard.ZstdCompressor(level=settings.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: memoryview | bytes) -> tuple[float, ...]:
        """Normalised difference, log compression rates of the text and of its most and least compressible block, log length."""
        g, b = self.pair
        sizes = np.array([(len(g.compress(x)) - 4, len(b.compress(x)) - 4, len(x)) for x in _blocks(text, self.block)] or [(1, 1, 1)], float)
        sizes[:, :2] = np.maximum(sizes[:, :2], 1)
        good, bad, n = sizes.sum(0)
        rate = np.log(sizes[:, :2].min(1) / sizes[:, 2])
        d = (sizes[:, 1] - sizes[:, 0]) / np.maximum(sizes[:, 0], sizes[:, 1])
        return (bad - good) / max(good, bad), np.log(min(good, bad) / n), rate.min(), rate.max(), d.min(), d.max(), np.log(n + 1)


def _expand(x: np.ndarray) -> np.ndarray:
    """The terms of the calibration: the features (clipped), their squares, products with the length, and one."""
    d = np.clip(x[:, [0, 4, 5]] * 8, -6, 6)
    r = np.clip(x[:, 1:4], -6, 1)
    n = x[:, 6:] / 10
    base = np.hstack([d, r, n])
    low = np.maximum(0, -1.2 - r)  # texts that compress far below what prose does
    return np.hstack([base, base**2, d * n, r * n, d * r, low, np.maximum(0, d), np.ones((len(x), 1))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by Newton steps; both classes weigh alike as given."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on labelled documents that are not held out.

    Labels other than 0 and 1, and documents with both, are not used. A null text counts as
    empty. With fewer than two classes the model scores every text as the one class (no
    labels at all: 1).
    """
    # The shares of the classes as labelled, which the calibration keeps.
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    counts = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(b"", b"", (6.0 if counts.get(0, 0) == 0 else -6.0,), settings)
    most = settings.dictionary_docs + settings.calibration_docs
    order = F.xxhash64(F.lit(5), F.col("doc_id"))
    ids: dict[int, list[int]] = {}
    for q in (0, 1):
        some = known.where(F.col("q") == q).select("doc_id").orderBy(order, "doc_id").limit(most).collect()
        ids[q] = sorted((r["doc_id"] for r in some), key=lambda i: (zlib.crc32(b"%d" % i), i))
    cut = {q: min(settings.dictionary_docs, max(1, len(v) // 2)) for q, v in ids.items()}
    good, bad = (_dictionary(_texts(documents, ids[q][: cut[q]], settings), settings) for q in (1, 0))
    if not good or not bad:
        return Model(b"", b"", (6.0 if good or not bad else -6.0,), settings)
    of = {i: q for q in (0, 1) for i in ids[q][cut[q] :] or ids[q]}
    rows = _measured(documents, good, bad, of, settings)
    x, y = _expand(np.array([r[1:] for r in rows], float)), np.array([of[r[0]] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(b"", b"", (6.0 if y.sum() else -6.0,), settings)
    w = _logistic(x, y, settings.ridge)
    # The sample is taken by class; the intercept moves to the labelled shares.
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, tuple(float(v) for v in w), settings)


def _chosen(documents: DataFrame, ids: list[int]) -> DataFrame:
    """doc_id and text of the documents with one of a bounded number of ids; rows that are alike count once."""
    known = F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.join(known, "doc_id").distinct()


def _texts(documents: DataFrame, ids: list[int], settings: Settings) -> list[bytes]:
    """The texts for a dictionary; of a long one blocks from its start to its end, cut out on the executors."""
    n, block = settings.longest_sample // settings.block_bytes, settings.block_bytes
    spread = f"transform(sequence(0, {n - 1}), i -> substring(data, cast(1 + cast(i as bigint) * (octet_length(data) - {block}) div {max(n - 1, 1)} as int), {block}))"
    rows = _chosen(documents, ids).select("doc_id", F.col("text").cast("binary").alias("data"))
    rows = rows.select("doc_id", F.expr(f"CASE WHEN octet_length(data) <= {settings.longest_sample} THEN array(data) ELSE {spread} END").alias("parts")).collect()
    found = [(r["doc_id"], b"".join(r["parts"])) for r in rows]
    return [t for _, t in sorted(found, key=lambda x: (zlib.crc32(b"%d" % x[0]), *x))]


def _measured(documents: DataFrame, good: bytes, bad: bytes, of: dict[int, int], settings: Settings) -> list[tuple]:
    """doc_id and features of the documents of the calibration: whole texts of any length, measured where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(good, bad, settings)
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch, "text"):
                data = memoryview(np.ascontiguousarray(buf))
                rows = [sizes.features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(_FEATURES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", *(f"f{k}" for k in range(_FEATURES))])

    schema = "doc_id long, " + ", ".join(f"f{k} double" for k in range(_FEATURES))
    return sorted(tuple(r) for r in _chosen(documents, list(of)).mapInArrow(run, schema).collect())


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: better) and ``predicted`` (1 from the threshold on); columns of these names are replaced.

    A null text is scored as an empty one. Every row gets its score from its text alone, so
    repeated rows have equal scores and a null doc_id changes nothing; an empty table gives an empty table.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    sent = documents.sparkContext.broadcast(model) if hasattr(documents, "sparkContext") else documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sizes = _Sizes(m.good, m.bad, m.settings) if m.good or m.bad else None
        for batch in batches:
            values = np.empty(batch.num_rows)
            for lo, hi, buf, offsets in slices(batch, "text"):
                if sizes is None:
                    values[lo:hi] = m.weights[0]
                    continue
                data = memoryview(np.ascontiguousarray(buf))
                x = np.array([sizes.features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                values[lo:hi] = _expand(x) @ np.array(m.weights)
            out = pa.array(1 / (1 + np.exp(-np.clip(values, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), out], names=[*kept, "score"])

    scored = documents.select(*kept).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id is not held out. Other columns are ignored."""
    model = fit(documents, labels, settings)
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
