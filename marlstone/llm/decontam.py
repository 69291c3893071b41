"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words that looks at some places and ignores the others.
Benchmark items and documents are hashed under the same masks at every word; equal hashes
are hits, also where the ignored words differ. Around each hit the two texts are compared
word by word along the hit's diagonal, and the overlap is extended both ways for as long as
enough words agree, so an overlap may have words replaced. A document is contaminated by an
item if an overlap is long enough in words, or covers most of a short item.

The index of the benchmark (its words and seed hashes) is sent to all executors if its counted
size is within a bound; then documents are read once and never shuffled. A benchmark beyond
the bound is joined with the seed hits of the documents by hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import NON_ALNUM, hash_spans, mix, slices, spans

#: Fixed masks; 1 looks at a word. Any 13 words with one of them replaced agree under one of the masks somewhere.
MASKS = ("11111111", "1110110111", "110111010111", "111010011001111")


@dataclass(frozen=True)
class Settings:
    """masks: of the seeds. least_words: of an overlap. agree: least share of equal words in an overlap.
    short_share: an item shorter than least_words / short_share counts as found if an overlap covers this share of it.
    drop: an extension ends when its score falls so far below its best (a word replaced costs 3, an equal one gains 1).
    broadcast_bytes: bound of the benchmark's text for the broadcast way.
    """

    masks: tuple[str, ...] = MASKS
    least_words: int = 13
    agree: float = 0.8
    short_share: float = 0.8
    drop: int = 7
    broadcast_bytes: int = 4 << 20  #: a benchmark of more bytes (or a chunk of it) is not held by a task: its index takes some 70 times as much, so under 300 MB


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts (runs of letters and digits; ASCII punctuation is ignored), and the number of each text's first."""
    starts, ends, first = spans(buf, offsets, NON_ALNUM)
    return hash_spans(buf, starts, ends), first


def seed_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each run of len(mask) words at the places that the mask looks at."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(h)


class Index:
    """Words of all items in a row, and their seed hashes sorted with the places they come from."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        words, first = [], [np.zeros(1, np.int64)]
        for _, _, buf, offsets in slices(batch, "text", lower=True):
            w, f = word_hashes(buf, offsets)
            words.append(w)
            first.append(f[1:] + first[-1][-1])
        self.ids, self.words, self.first = np.array(ids, np.int64), np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate(first)
        hashes, places = [], []
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.words))
        for k, mask in enumerate(s.masks):
            h = seed_hashes(self.words, mask, k)
            at = np.flatnonzero(left[: len(h)] >= len(mask))
            hashes.append(h[at])
            places.append(at)
        # Items of fewer words than the shortest mask are looked up as one run of all their words.
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.diff(self.first)
        for n in sorted({int(x) for x in sizes if 0 < x < min(map(len, s.masks))}):
            at = self.first[:-1][sizes == n]
            h = seed_hashes(self.words, "1" * n, 100 + n)[at]
            by = np.argsort(h, kind="stable")
            self.whole[n] = h[by], at[by]
        h, at = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)])
        by = np.argsort(h, kind="stable")
        self.hashes, self.places = h[by], at[by]
        self.item = np.repeat(np.arange(len(self.ids)), sizes)
        self.filter_bits = max(16, int(np.ceil(np.log2(len(h) * 16 + 1))))
        self.filter = np.zeros(1 << self.filter_bits, bool)
        for x in (h, *(w[0] for w in self.whole.values())):
            self.filter[(x >> np.uint64(64 - self.filter_bits)).astype(np.int64)] = True


def _lookup(index: Index, h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place among h, place in the index) of every hit."""
    at = np.flatnonzero(index.filter[(h >> np.uint64(64 - index.filter_bits)).astype(np.int64)])
    lo, hi = (np.searchsorted(table[0], h[at], side) for side in ("left", "right"))
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    total = np.cumsum(n)
    inside = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
    return np.repeat(at, n), table[1][np.repeat(lo, n) + inside]


def overlap(doc: np.ndarray, item: np.ndarray, at: int, place: int, drop: int) -> tuple[int, int, int]:
    """Extends the hit at doc[at] and item[place] along its diagonal: (start in doc, length, equal words)."""
    before, after = min(at, place), min(len(doc) - at, len(item) - place)
    same = doc[at - before : at + after] == item[place - before : place + after]

    def reach(x: np.ndarray) -> int:
        if not len(x):
            return 0
        score = np.cumsum(np.where(x, 1, -3))
        best = np.maximum.accumulate(score)
        dead = np.flatnonzero(best - score > drop)
        score = score[: dead[0]] if len(dead) else score
        k = int(np.argmax(score)) if len(score) else 0
        return k + 1 if len(score) and score[k] > 0 else 0

    a, b = before - reach(same[:before][::-1]), before + reach(same[before:])
    return at - before + a, b - a, int(same[a:b].sum())


def find(words: np.ndarray, first: np.ndarray, index: Index, s: Settings) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start, length, equal words, hits) of the best overlap of every text with every item that contaminates it."""
    if not len(words) or not len(index.words):
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    docs, places = [], []
    for k, mask in enumerate(s.masks):
        at, place = _lookup(index, seed_hashes(words, mask, k), (index.hashes, index.places))
        ok = left[at] >= len(mask)
        docs.append(at[ok])
        places.append(place[ok])
    for n, table in index.whole.items():
        at, place = _lookup(index, seed_hashes(words, "1" * n, 100 + n), table)
        ok = left[at] >= n
        docs.append(at[ok])
        places.append(place[ok])
    at, place = np.concatenate(docs), np.concatenate(places)
    # One look for each diagonal of a text and an item.
    key = np.stack([text[at], index.item[place], at - place, at])
    order = np.lexsort(key[::-1])
    key, at, place = key[:, order], at[order], place[order]
    best: dict[tuple[int, int], tuple] = {}
    hits: dict[tuple[int, int], int] = {}
    done = (-1, -1, 0, -1)
    for t, i, diagonal, a, p in zip(*key[:3].tolist(), at.tolist(), place.tolist(), strict=True):
        hits[t, i] = hits.get((t, i), 0) + 1
        if (t, i, diagonal) == done[:3] and a < done[3]:
            continue
        d0, i0 = int(first[t]), int(index.first[i])
        item = index.words[i0 : int(index.first[i + 1])]
        start, length, same = overlap(words[d0 : int(first[t + 1])], item, a - d0, p - i0, s.drop)
        done = (t, i, diagonal, d0 + start + length)
        need = min(s.least_words, max(1, int(np.ceil(s.short_share * len(item)))))
        if length >= need and same >= s.agree * length and (same, length) > best.get((t, i), (0, 0))[:2]:
            best[t, i] = (same, length, start)
    return [(t, i, start, length, same, hits[t, i]) for (t, i), (same, length, start) in best.items()]


_SCHEMA = "doc_id long, item_id long, first_word long, n_words long, n_equal long, n_hits long"


def overlaps(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and benchmark item with an overlap: the best one, in words from 0, and the seed hits.

    Clean documents have no row. A null or empty text overlaps with nothing. A null doc_id or
    item_id is carried as null; rows with the same id are judged each by its own text.
    """
    s = settings
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > s.broadcast_bytes:
        return _joined(documents, items, size, s)
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, r))
    return _with_index(documents, rows, s)


def _with_index(documents: DataFrame, rows: list[tuple], s: Settings) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast((rows, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, s = sent.value
        index = Index(list(range(len(rows))), [r[1] for r in rows], s)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, buf, offsets in slices(batch, "text", lower=True):
                words, first = word_hashes(buf, offsets)
                found = find(words, first, index, s)
                cols = [[ids[lo + f[0]] for f in found], [rows[f[1]][0] for f in found], *([f[k] for f in found] for k in range(2, 6))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "first_word", "n_words", "n_equal", "n_hits"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _joined(documents: DataFrame, items: DataFrame, size: int, s: Settings) -> DataFrame:
    """For a large benchmark: candidate pairs from a join of seed hashes, then the overlaps of each document with its candidates."""

    least = min(map(len, s.masks))

    def seeds(runs: tuple[int, ...], whole: bool):
        """Seed hashes of each text: of all masks, and of the given short runs of words (whole: only if the text is no longer)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, buf, offsets in slices(batch, "text", lower=True):
                    words, first = word_hashes(buf, offsets)
                    sizes = np.diff(first)
                    text = np.repeat(np.arange(lo, hi), sizes)
                    left = np.repeat(first[1:], sizes) - np.arange(len(words))
                    for number, mask in [*enumerate(s.masks), *((100 + n, "1" * n) for n in runs)]:
                        h = seed_hashes(words, mask, number)
                        ok = left[: len(h)] >= len(mask)
                        if whole and number >= 100:
                            ok &= np.repeat(sizes, sizes)[: len(h)] == len(mask)
                        at = np.flatnonzero(ok)
                        pairs = np.unique(np.stack([text[at].astype(np.uint64), h[at]]), axis=1)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=["id", "h"])

        return run, "id long, h long"

    def short_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in slices(batch, "text", lower=True):
                n = np.unique(np.diff(word_hashes(buf, offsets)[1]))
                yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < least)].astype(np.int64))], names=["n"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    items = items.withColumn("row", F.xxhash64("item_id", "text"))
    # Numbers of words below a mask's: a handful.
    runs = tuple(sorted(r["n"] for r in items.select("text").mapInArrow(short_sizes, "n long").distinct().collect()))
    a = docs.select("row", "text").mapInArrow(*seeds(runs, False)).withColumnRenamed("id", "doc_row")
    b = items.select("row", "text").mapInArrow(*seeds(tuple(range(1, least)), True)).withColumnRenamed("id", "item_row")
    pairs = a.join(b, "h").select("doc_row", "item_row").distinct()
    # A document goes to its candidates once for each chunk of the benchmark, which is as large as a broadcast one may be.
    chunk = F.pmod("item_row", F.lit(-(-size // max(1, s.broadcast_bytes))))
    some = pairs.join(items, pairs["item_row"] == items["row"]).groupBy("doc_row", chunk).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    rows = some.join(docs, some["doc_row"] == docs["row"]).select("doc_id", "text", "items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, some in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                index = Index(list(range(len(some))), [x["text"] for x in some], s)
                for _, _, buf, offsets in slices(pa.RecordBatch.from_pydict({"text": [text]}), "text", lower=True):
                    out += [(d, some[f[1]]["item_id"], *f[2:]) for f in find(*word_hashes(buf, offsets), index, s)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names=["doc_id", "item_id", "first_word", "n_words", "n_equal", "n_hits"])

    return rows.mapInArrow(check, _SCHEMA)


def contaminated(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each contaminated doc_id: its items, and the longest overlap in equal words.

    Rows with the same doc_id are counted together, those with a null doc_id as one, too (``overlaps`` has them
    apart); a null item_id is not among the items. Without documents or items there is no row.
    """
    found = overlaps(documents, benchmark, settings)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_equal").alias("most_equal"), F.max("n_words").alias("most_words"), F.sum("n_hits").alias("n_hits"))
