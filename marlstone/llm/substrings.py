"""Repeated passages: words covered by a window of words that also starts earlier in the corpus are removed.

1. Texts that equal an earlier text are found by checksum. All their windows start earlier, so
   they are settled; the later steps see one text of each kind.
2. Every window has an anchor, the run of a few words in it with the least hash (the leftmost
   of equal ones). Equal windows have equal anchors at the same place, so an anchor's hash says
   which windows can be equal at all. Anchors that occur once are dropped; some one in eight
   words is an anchor.
3. The windows of each anchor that recurs form a segment of consecutive words. Segments are
   dealt by the anchor's hash, so windows that may be equal meet. A task sends a segment that it
   has sent before only if it stands earlier than that one; otherwise it is settled at once.
   So a passage that a third of all documents share is sent about once by each task.
   The segments of an anchor that occurs very often, each time among other words, are cut in two
   by where the windows stand to the anchor, and each half is dealt by the longer run of words
   that all its windows share; and so on, up to single windows, as long as a run is too frequent.
4. In each shard (the segments of whole keys, up to a bound of words) a compressed FM-index of
   the segments is built and all segments are streamed through it by backward search. The
   matching statistics give for every window the range of its occurrences, and the earliest of
   them decides. Segments carry their words themselves, so hashes only deal and never decide.
5. The intervals go back to the documents, and the kept words are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import BROADCAST_ROWS, small
from .fmindex import FMIndex
from .storage import Scratch
from .neardup import whole_groups
from .textkernel import BLANKS, grams, hash_spans, keyed, room, slices, spans

#: Segments that a task remembers to have sent.
_REMEMBERED = 1 << 19

@dataclass(frozen=True)
class Settings:
    """window: in words (17 to 32). anchor: words of an anchor. shard_words: of an index, about: some 2 MB of text, as the slices of other
    steps, so that a worker needs no more memory for an index than for them. key_rows: occurrences of a key
    above which it is replaced by longer ones.
    """

    window: int = 20
    anchor: int = 6
    shard_words: int = 1 << 18
    key_rows: int = 8192


def anchors(words: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, end of windows) of each anchor; windows count by their first word."""
    empty = (np.zeros(0, np.int64),) * 4
    w = s.window - s.anchor + 1  # anchors that a window has to choose from
    g = grams(words, s.anchor)
    if len(g) < w:
        return empty
    # The place of the least hash among the next 1, 2, 4, ... and w runs; the left one of equals.
    least, span = np.arange(len(g)), 1
    while span * 2 <= w:
        a, b = least[:-span], least[span:]
        least, span = np.where(g[a] <= g[b], a, b), span * 2
    a, b = least[: len(g) - w + 1], least[w - span : len(g) - span + 1]
    least = np.where(g[a] <= g[b], a, b)
    start = np.flatnonzero(room(first)[: len(least)] >= s.window)
    if not len(start):
        return empty
    at = least[start]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    ends = np.append(edge[1:], len(start)) - 1
    return at[edge], g[at[edge]].view(np.int64), start[edge], start[ends] + 1


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, hashes of words, number of each text's first word, and all words joined by blanks with where each starts."""
    for lo, _, buf, offsets in slices(batch, "text"):
        starts, ends, first = spans(buf, offsets, BLANKS)
        sizes = ends - starts
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = np.full(int(at[-1]), 0x20, np.uint8)
        if len(starts):
            inside = np.arange(int(sizes.sum()))
            before = np.repeat(np.cumsum(sizes) - sizes, sizes)
            joined[inside - before + np.repeat(at[:-1], sizes)] = buf[inside - before + np.repeat(starts, sizes)]
        yield lo, hash_spans(buf, starts, ends), first, joined, at


def _find_anchors(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, first in _hashed(batch):
                at, h, _, _ = anchors(words, first, s)
                doc = np.searchsorted(first, at, "right") - 1
                rows = pa.array(lo + doc)
                # One row of each anchor meets those of other tasks; its further rows here are known to recur and go anywhere.
                _, one, back, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                often = often[back].astype(np.int32)
                rest = np.ones(len(h), bool)
                rest[one] = False
                key = np.where(rest, keyed(h.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 13).view(np.int64), h)
                # How often the anchor is here, negative in the rows that go anywhere.
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[doc]).astype(np.int32)), pa.array(np.where(rest, -often, often))], names=["anchor", "doc", "text_hash", "at", "often"])

    return run, "anchor long, doc long, text_hash long, at int, often int"


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, buf, offsets in slices(batch, "text"):
        starts, ends, first = spans(buf, offsets, BLANKS)
        yield lo, hash_spans(buf, starts, ends), first


def _recurring(s: Settings):
    """Rows of anchors that recur, and one without a doc for each anchor that is too frequent. No group is held: one row is, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, pending = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, often = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size, sums = np.diff(np.append(edge, len(keys))), np.add.reduceat(np.maximum(often, 0).astype(np.int64), edge)
            keep = np.repeat(size > 1, size) | (np.abs(often) > 1)
            hot, out = [], []
            if key == keys[0]:
                sums[0] += total
                keep[0] = True
                if pending is not None:
                    out.append(pending)
            elif total > s.key_rows:
                hot.append(key)
            full = np.flatnonzero(sums[:-1] > s.key_rows)
            hot += keys[edge[full]].tolist()
            key, total = int(keys[-1]), int(sums[-1])
            alone = size[-1] == 1 and not keep[-1]
            pending = batch.slice(batch.num_rows - 1) if alone else None
            out.append(batch.filter(pa.array(keep)))
            yield from (_found(x) for x in out if x.num_rows)
            if hot:
                yield _marks(hot)
        if total > s.key_rows:
            yield _marks([key])

    return run, "doc long, text_hash long, at int, hot long"


def _found(rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(rows.column(k) for k in (1, 2, 3)), pa.nulls(rows.num_rows, pa.int64())], names=["doc", "text_hash", "at", "hot"])


def _marks(keys: list[int]) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(keys), pa.int32()), pa.array(keys, pa.int64())], names=["doc", "text_hash", "at", "hot"])


_SEGMENT = "anchor long, doc long, text_hash long, start int, n_windows int, lead int, words binary"


class _Sent:
    """Segments that this task has sent, with their earliest place so far."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def settled(self, words: bytes, place: tuple[int, int]) -> bool:
        """Whether an equal segment has been sent that stands earlier; if not, this one counts as sent."""
        it = hashlib.blake2b(words, digest_size=16).digest()
        earlier = self.known.get(it)
        if earlier is not None and earlier < place:
            return True
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[it] = place
        return False


def _anywhere(key: int, place: int) -> int:
    """A key for rows that only pass through the shards, so that no shard gets more of them than others."""
    x = (key * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 29) - (1 << 63)


def _segment_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], names=_NAMES)


def _segments(s: Settings):
    """Segments of recurring anchors; those without words are settled: all their windows start earlier. lead: words from the first window's start to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            docs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(3)
            for lo, words, first, joined, at in _words(batch):
                place, h, a, b = anchors(words, first, s)
                if not len(place):
                    continue
                part = lists.slice(lo, len(first) - 1)
                given = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([len(x) for x in part])
                known = np.unique(given + np.repeat(first[:-1], sizes))
                near = np.searchsorted(known, place)
                near[near == len(known)] = 0
                keep = known[near] == place
                place, h, a, b = place[keep], h[keep], a[keep], b[keep]
                doc = np.searchsorted(first, a, "right") - 1
                data = joined.tobytes()
                begin, end = at[a], at[b - 1 + s.window] - 1
                out = []
                for x, y, key, lead, d, i, j in zip(a.tolist(), b.tolist(), h.tolist(), (place - a).tolist(), doc.tolist(), begin.tolist(), end.tolist(), strict=True):
                    text, me = data[i:j], (docs[lo + d], x - int(first[d]))
                    if sent.settled(text, me):
                        key, text = _anywhere(key, x), None
                    out.append((key, me[0], hashes[lo + d], me[1], y - x, lead, text))
                yield _segment_batch(out)

    return run, _SEGMENT


def levels(s: Settings) -> int:
    """After so many halvings all segments are single windows."""
    return (s.window - s.anchor).bit_length()


def _split(s: Settings, level: int):
    """Segments cut by where their windows stand to the anchor, into 2**level ranges; the key is the run of words that all windows of a range share."""
    n = s.window - s.anchor + 1
    edges = [k * n // 2**level for k in range(2**level + 1)]
    ranges = [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                out = []
                for _, doc, text_hash, start, n_windows, lead, text in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns), strict=True):
                    words = text.split(b" ")
                    last = lead - n_windows + 1  # words before the anchor in the last window
                    for lo, hi in ranges:
                        a, b = min(hi, lead), max(lo, last)
                        if a < b:
                            continue
                        mine = b" ".join(words[lead - a : lead - b + s.window])
                        core = b" ".join(words[lead - lo : lead - hi + s.window])
                        key = int.from_bytes(hashlib.blake2b(b"%d %d " % (level, lo) + core, digest_size=8).digest(), "little", signed=True)
                        place = start + lead - a
                        if sent.settled(mine, (doc, place)):
                            key, mine = _anywhere(key, place + doc), None
                        out.append((key, doc, text_hash, place, a - b + 1, a, mine))
                yield _segment_batch(out)

    return run, _SEGMENT


_NAMES = ["anchor", "doc", "text_hash", "start", "n_windows", "lead", "words"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_INTERVAL = "doc long, text_hash long, first int, last int"


def _intervals(doc, text_hash, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc", "text_hash", "first", "last"])


def repeated_windows(docs: np.ndarray, starts: np.ndarray, words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first and last window) of the runs of windows with an earlier start among the segments, by an FM-index of them."""
    seq = np.repeat(np.arange(len(docs)), np.diff(first))
    _, rank = np.unique(docs, return_inverse=True)
    key = (rank[seq].astype(np.int64) << 32) + starts[seq] + np.arange(len(words)) - first[:-1][seq]
    index = FMIndex(words, first, window, key)
    _, group = index.search(words, first)
    gone = np.flatnonzero((group >= 0) & (index.least[group] < key))
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    edge = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (seq[gone][1:] != seq[gone][:-1])])
    a = gone[edge]
    b = gone[np.append(np.flatnonzero(edge)[1:], len(gone)) - 1]
    return seq[a], starts[seq[a]] + a - first[:-1][seq[a]], starts[seq[b]] + b - first[:-1][seq[b]]


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes and only for these: hashes that are checked against the bytes."""
    _, one, back = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    like, sizes = one[back], ends - starts
    same = bool((sizes == sizes[like]).all())
    for lo in range(0, len(starts) if same else 0, 1 << 16):
        part = slice(lo, lo + (1 << 16))
        n = sizes[part]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(buf[np.repeat(starts[part], n) + inside], buf[np.repeat(starts[like[part]], n) + inside]):
            same = False
            break
    if same:
        return back
    numbers: dict[bytes, int] = {}
    data = buf.tobytes()
    return np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def _search(s: Settings):
    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = batch.column(6)
        null = words.is_null().to_numpy(zero_copy_only=False)
        doc, text_hash, start, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        if null.any():
            yield _intervals(doc[null], text_hash[null], start[null], start[null] + n[null] - 1)
        if (~null).sum() > 1:
            doc, text_hash, start, n = (x[~null] for x in (doc, text_hash, start, n))
            buf = np.frombuffer(b" ".join(words.drop_null().to_pylist()), np.uint8)
            begin, end, _ = spans(buf, np.array([0, len(buf)]), BLANKS)
            first = np.concatenate([[0], np.cumsum(n.astype(np.int64) + s.window - 1)])
            seg, a, b = repeated_windows(doc, start.astype(np.int64), word_codes(buf, begin, end), first, s.window)
            if len(seg):
                yield _intervals(doc[seg], text_hash[seg], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in whole_groups(batches):
            held.append(batch)
            size += int(batch.column(4).to_numpy().astype(np.int64).sum()) + s.window * batch.num_rows
            if size >= s.shard_words:
                yield from _cut(held, s, settle)
                held, size = [], 0
        if held:
            yield from _cut(held, s, settle)

    return run, _INTERVAL


def _cut(held: list[pa.RecordBatch], s: Settings, settle) -> Iterator[pa.RecordBatch]:
    """Shards of whole anchors, of about shard_words words each."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    keys = batch.column(0).to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.cumsum(batch.column(4).to_numpy().astype(np.int64) + s.window)
    lo = 0
    while lo < batch.num_rows:
        most = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + s.shard_words, "right"))
        k = int(np.searchsorted(edge, most, "right")) - 1
        hi = int(edge[k]) if edge[k] > lo else int(edge[np.searchsorted(edge, lo, "right")])
        yield from settle(batch.slice(lo, hi - lo))
        lo = hi


def _keep_words(s: Settings, carried: list[T.StructField]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copy, ranges in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if copy and n >= s.window:
                    words = []
                elif ranges.is_valid and n:
                    a, b = (ranges.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, np.minimum(b + s.window, n), -1)
                    gone = np.cumsum(step)[:n] > 0
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if len(words) < n else text.as_py() or ""))
            n, gone, sha, kept = zip(*rows, strict=True) if rows else ([],) * 4
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    schema = T.StructType.fromDDL("doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    for f in carried:
        schema = schema.add(f)
    return run, schema


def remove_repeats(documents: DataFrame, settings: Settings = Settings(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row of ``documents`` (doc_id, text), and the columns in ``carry``.

    The checksum is of the kept words joined by one blank; kept_text is that too, or the text
    itself where no word goes. A null text has no words. An earlier start is one in a
    smaller doc_id, or at an earlier word under the same doc_id; so identical rows don't remove
    one another's words. A null doc_id comes after all others. An empty table gives an empty
    table. Other columns are ignored.
    """
    s = settings
    last = F.lit((1 << 63) - 1)
    scratch = Scratch(documents.sparkSession, "substrings")
    docs_columns = (F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    docs = documents.select(*docs_columns)
    keys = ["doc", "text_hash"]
    # Later copies of whole texts.
    sums = docs.where(F.octet_length("text") > 2 * s.window - 2).select("doc", "text_hash", F.xxhash64(F.lit(7), "text").alias("second"))
    kinds = scratch.save(sums, "sums")
    again = kinds.groupBy("text_hash", "second").agg(F.min("doc").alias("first"), F.max("doc").alias("most")).where("most > first").drop("most")
    again = scratch.save(again, "again")
    n_again = again.count()
    if n_again <= BROADCAST_ROWS:
        later = kinds.join(F.broadcast(again), ["text_hash", "second"])
    else:  # a text with very many copies is met in many tasks
        later = kinds.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int"))
        later = later.join(again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["text_hash", "second", "salt"])
    copies = scratch.save(later.where("doc > first").select(*keys).distinct(), "copies")
    n_copies = copies.count()
    single = docs.join(small(copies, n_copies), keys, "left_anti")
    # Anchors that recur, by document.
    found = single.mapInArrow(*_find_anchors(s)).repartition("anchor").sortWithinPartitions("anchor")
    found = scratch.save(found.mapInArrow(*_recurring(s)), "found")
    places = found.where("doc IS NOT NULL").groupBy(*keys).agg(F.collect_list("at").alias("places"))
    rows = docs.join(places, keys).select("doc", "text_hash", "text", "places").mapInArrow(*_segments(s))
    hot = found.where("doc IS NULL").select(F.col("hot").alias("anchor")).distinct()
    gone, single = None, levels(s)
    for level in range(single + 1):
        n_hot = hot.count() if level < single else 0
        if n_hot and level == 0:
            rows = scratch.save(rows, "segments-0")
        cold = rows.join(small(hot, n_hot), "anchor", "left_anti") if n_hot else rows
        shards = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(*_search(s))
        gone = shards if gone is None else gone.unionByName(shards)
        if not n_hot:
            break
        rows = scratch.save(rows.join(small(hot, n_hot), "anchor", "left_semi").mapInArrow(*_split(s, level + 1)), f"segments-{level + 1}")
        hot = rows.where("words IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.key_rows).select("anchor")
    gone = scratch.save(gone.groupBy(*keys).agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    scratch.drop("found", "sums", "again", *(f"segments-{k}" for k in range(single + 1)))
    marked = small(copies.withColumn("copy", F.lit(True)), n_copies)
    if carry:
        docs = documents.select(*docs_columns, *(F.col(c).alias(f"c_{c}") for c in carry))
    fields = [docs.schema[f"c_{c}"] for c in carry]
    out = docs.join(marked, keys, "left").join(gone, keys, "left").select("doc", "text", "copy", "ranges", *(f.name for f in fields)).mapInArrow(*_keep_words(s, fields))
    return out.select(F.when(F.col("doc") < last, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", *(F.col(f"c_{c}").alias(c) for c in carry))
