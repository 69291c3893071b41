"""How the sources of a language differ in their words: an audit by mergeable radix tries.

1. Every task counts the terms of its documents in a byte trie for each language. A leaf has a
   counter for each source: occurrences and documents. A trie is stored in preorder, which is the
   order of UTF-8: for each leaf the depth at which its path leaves that of the leaf before and the bytes
   of the edge below. Pieces of at most PIECE leaves are written to the shared folder.
2. Pieces are cut at prefixes that part the leaves of a language evenly, and the pieces of one
   prefix range are merged leaf by leaf. Terms in enough documents of the language are kept, again as pieces.
3. The totals of all groups are summed, and the kept tries are traversed once more: each piece adds to the sums of all
   pairs of sources and gives, in order, the terms that stand out in each source.

The rows that meet in one task are pieces of one prefix range, whatever a language, a source or a
word makes up of the corpus; each word comes once from each trie, with its counts.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import small
from .pieces import ragged
from .storage import Scratch
from .textkernel import LOWER, slices, spans

#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: bytes that end a term.
NON_LETTER = np.zeros(256, bool)
NON_LETTER[:0x80] = True
NON_LETTER[0x41:0x5B] = False
NON_LETTER[0x61:0x7B] = False

PIECE = 512
_PREFIX = 7
_SCALE, _SMOOTH = 10**9, 5


@dataclass(frozen=True)
class Settings:
    least_docs: int = 30  #: documents of its language that a term must be in
    top: int = 50  #: terms reported for each group
    held: int = 1 << 20  #: counters that a task holds before it writes its tries
    range_counters: int = 1 << 18  #: counters that one prefix range should have before its pieces are merged
    block: int = 128  #: sources whose pair sums are held at once


@dataclass
class Trie:
    """Leaves in preorder and their counters, sorted by leaf and group."""

    terms: pa.Array  #: the path of each leaf (large_binary)
    leaf: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    @staticmethod
    def merge(tries: list[Trie]) -> Trie:
        """One trie with all leaves and the sums of their counters; groups must be numbered alike."""
        names = pa.concat_arrays([t.terms for t in tries]).dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        place = place[names.indices.to_numpy()]
        base = np.cumsum([0, *(len(t.terms) for t in tries)])
        leaf = np.concatenate([place[t.leaf + b] for t, b in zip(tries, base[:-1], strict=True)])
        group, n, docs = (np.concatenate([getattr(t, k) for t in tries]) for k in ("group", "n", "docs"))
        by = np.lexsort((group, leaf))
        leaf, group = leaf[by], group[by]
        first = np.flatnonzero(np.diff(leaf, prepend=-1) | np.diff(group, prepend=-1)) if len(leaf) else np.zeros(0, np.int64)
        total = (lambda x: np.add.reduceat(x[by], first)) if len(first) else (lambda x: x)
        return Trie(names.dictionary.take(order), leaf[first], group[first], total(n), total(docs))

    def part(self, a: int, b: int) -> Trie:
        """Leaves a to b - 1."""
        lo, hi = np.searchsorted(self.leaf, (a, b))
        return Trie(self.terms.slice(a, b - a), self.leaf[lo:hi] - a, self.group[lo:hi], self.n[lo:hi], self.docs[lo:hi])

    def select(self, keep: np.ndarray) -> Trie:
        """The counters that keep marks, and the leaves that have one of them."""
        leaves, leaf = np.unique(self.leaf[keep], return_inverse=True)
        return Trie(self.terms.take(pa.array(leaves)), leaf, self.group[keep], self.n[keep], self.docs[keep])

    def pack(self) -> bytes:
        offsets, data = _buffers(self.terms)
        size = np.diff(offsets)
        shared = np.zeros(len(size), np.int64)
        alike, depth = np.arange(1, len(size)), 0
        while len(alike):
            alike = alike[(size[alike - 1] > depth) & (size[alike] > depth)]
            alike = alike[data[offsets[alike - 1] + depth] == data[offsets[alike] + depth]]
            depth += 1
            shared[alike] = depth
        edge = size - shared
        tails = data[ragged(offsets[:-1] + shared, edge)]
        width = np.bincount(self.leaf, minlength=len(size))
        ints = (self.n.astype("<i8"), self.docs.astype("<i8"), self.group.astype("<u4"), shared.astype("<u4"), edge.astype("<u4"), width.astype("<u4"), tails)
        return struct.pack("<QQ", len(size), len(self.n)) + b"".join(x.tobytes() for x in ints)

    @staticmethod
    def unpack(data: bytes) -> Trie:
        leaves, entries = struct.unpack_from("<QQ", data)
        at, arrays = 16, []
        for kind, count in (("<i8", entries), ("<i8", entries), ("<u4", entries), ("<u4", leaves), ("<u4", leaves), ("<u4", leaves)):
            arrays.append(np.frombuffer(data, kind, count, at).astype(np.int64))
            at += arrays[-1].size * int(kind[2])
        n, docs, group, shared, edge, width = arrays
        path, terms = b"", []
        for keep, more in zip(shared.tolist(), edge.tolist(), strict=True):
            path = path[:keep] + data[at : at + more]
            at += more
            terms.append(path)
        return Trie(pa.array(terms, pa.large_binary()), np.repeat(np.arange(leaves), width), group, n, docs)


def _buffers(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array."""
    data = terms.buffers()[2]
    return np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, terms.offset * 8), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def prefix(term: bytes) -> int:
    """The first bytes of a term as a number of the same order."""
    return int.from_bytes(term[:_PREFIX].ljust(_PREFIX, b"\0"), "big")


class _Counter:
    """The tries of a task."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[Trie] = []
        self.held = 0

    def add(self, buf: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        """Counts the terms of documents with the numbers of their groups."""
        starts, ends, first = spans(buf, offsets, NON_LETTER)
        if not len(starts):
            return
        size = ends - starts
        letters = np.ascontiguousarray(LOWER[buf[ragged(starts, size)]])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(letters)]).dictionary_encode()
        terms = len(words.dictionary)
        of = np.repeat(np.arange(len(groups)), np.diff(first))
        both, times = np.unique(of * terms + words.indices.to_numpy(), return_counts=True)
        key = both % terms * len(self.names) + groups[both // terms]
        by = np.argsort(key, kind="stable")
        key = key[by]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.parts.append(Trie(words.dictionary, key[at] // len(self.names), key[at] % len(self.names), np.add.reduceat(times[by], at), np.diff(np.append(at, len(key)))))
        self.held += len(at)

    def rows(self) -> Iterator[dict]:
        """All tries in pieces, which are then forgotten."""
        if self.parts:
            trie, names = Trie.merge(self.parts), list(self.names)
            langs = np.array([sorted({x for x, _ in names}).index(x) for x, _ in names])
            for k, lang in enumerate(sorted({x for x, _ in names})):
                own = trie.select(langs[trie.group] == k)
                yield from _pieces(own, lang, [s for _, s in names], {})
        self.parts, self.held = [], 0


def _pieces(trie: Trie, lang: str, sources: list[str], more: dict, size: int = PIECE) -> Iterator[dict]:
    for a in range(0, len(trie.terms), size):
        part = trie.part(a, min(a + size, len(trie.terms)))
        used, part.group = np.unique(part.group, return_inverse=True)
        low, high = (prefix(part.terms[i].as_py()) for i in (0, len(part.terms) - 1))
        totals = np.bincount(part.group, part.n, len(used)) if part.n.max() < 1 << 40 else [int(part.n[part.group == g].sum()) for g in range(len(used))]
        yield {"lang": lang, "low": low, "high": high, "leaves": len(part.terms), "counters": len(part.n), "sources": [sources[g] for g in used], "totals": [int(x) for x in totals], "trie": part.pack(), **more}


_PIECES = "lang string, low long, high long, leaves int, counters int, sources array<string>, totals array<long>, trie binary"


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARROW = pa.schema([("lang", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("leaves", pa.int32()), ("counters", pa.int32()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("trie", pa.binary())])


def count_terms(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of the tries of all tasks. Null texts, languages and sources count as empty."""
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _Counter()
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for pair in set(pairs) - set(tries.names):
                tries.names[pair] = len(tries.names)
            groups = np.array([tries.names[p] for p in pairs], np.int64)
            for lo, hi, buf, offsets in slices(batch, "text"):
                tries.add(buf, offsets, groups[lo:hi])
                if tries.held > settings.held:
                    yield from _batches(tries.rows(), _ARROW)
        yield from _batches(tries.rows(), _ARROW)

    return rows.mapInArrow(run, _PIECES)


def _cuts(pieces: DataFrame, settings: Settings) -> dict[str, list[int]]:
    """Prefixes that part the languages with more counters than one range should have: about one for each so many counters of the corpus' tries."""
    large = pieces.groupBy("lang").agg(F.sum("counters").alias("n")).where(F.col("n") > settings.range_counters)
    ranges = {r["lang"]: -(-r["n"] // settings.range_counters) for r in large.collect()}
    if not ranges:
        return {}
    most = max(ranges.values())
    wanted = F.percentile_approx("low", [k / most for k in range(1, most)], 20 * most)
    found = pieces.where(F.col("lang").isin(list(ranges))).groupBy("lang").agg(wanted.alias("cuts")).collect()
    return {r["lang"]: sorted({r["cuts"][len(r["cuts"]) * k // ranges[r["lang"]]] for k in range(1, ranges[r["lang"]])}) for r in found}


def merged_terms(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of the merged tries, with the terms that are in enough documents of their language only."""
    cuts = pieces.sparkSession.sparkContext.broadcast(_cuts(pieces, settings))
    with_range = pa.schema([*_ARROW, ("range", pa.int32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    at = cuts.value.get(r["lang"], [])
                    a, b = bisect_right(at, r["low"]), bisect_right(at, r["high"])
                    if a == b:
                        yield {**r, "range": a}
                        continue
                    trie = Trie.unpack(r["trie"])
                    of = np.array([bisect_right(at, prefix(t)) for t in trie.terms.to_pylist()])
                    for k in range(a, b + 1):
                        lo, hi = np.searchsorted(of, (k, k + 1)).tolist()
                        if lo < hi:
                            yield from _pieces(trie.part(lo, hi), r["lang"], r["sources"], {"range": k})

        yield from _batches(rows(), with_range)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple[str, int] | None, held: list[dict]) -> Iterator[dict]:
            if not held:
                return
            names = sorted({s for r in held for s in r["sources"]})
            number = {s: i for i, s in enumerate(names)}
            parts = []
            for r in held:
                part = Trie.unpack(r["trie"])
                part.group = np.array([number[s] for s in r["sources"]], np.int64)[part.group]
                parts.append(part)
            trie = Trie.merge(parts)
            docs = np.add.reduceat(trie.docs, np.flatnonzero(np.diff(trie.leaf, prepend=-1)))
            yield from _pieces(trie.select(docs[trie.leaf] >= settings.least_docs), key[0], names, {})

        def rows() -> Iterator[dict]:
            key, held = None, []
            for batch in batches:
                for r in batch.to_pylist():
                    if (r["lang"], r["range"]) != key:
                        yield from done(key, held)
                        key, held = (r["lang"], r["range"]), []
                    held.append(r)
            yield from done(key, held)

        yield from _batches(rows(), _ARROW)

    dealt = pieces.mapInArrow(deal, _PIECES + ", range int").repartition("lang", "range").sortWithinPartitions("lang", "range")
    return dealt.mapInArrow(merge, _PIECES)


def _shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / whole), in whole numbers of any size."""
    if counts.max(initial=0) + _SMOOTH <= 9 * 10**9:
        return 1 + (counts + _SMOOTH) * _SCALE // whole
    return (1 + (counts.astype(object) + _SMOOTH) * _SCALE // whole.astype(object)).astype(np.int64)


_FOUND = "lang string, source string, part string, item string, value long"
_FOUND_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _score(rows: Iterator[dict], settings: Settings) -> Iterator[dict]:
    """Sums of pairs and candidates of terms, over the pieces of one task."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    best: dict[tuple[str, int], list] = {}
    names: dict[str, list[str]] = {}
    for r in rows:
        lang, first = r["lang"], r["first"]
        names[lang] = r["all"]
        s, last = len(r["all"]), min(first + settings.block, len(r["all"]))
        total = sums.setdefault((lang, first), np.zeros((last - first, s), np.int64))
        if r["trie"] is None:
            continue
        number = {x: i for i, x in enumerate(r["all"])}
        trie = Trie.unpack(r["trie"])
        trie.group = np.array([number[x] for x in r["sources"]], np.int64)[trie.group]
        whole = np.array(r["n"], np.int64) + _SMOOTH * r["v"]
        of_lang = np.array([int(sum(r["n"])) + _SMOOTH * r["v"]])
        terms = [t.decode() for t in trie.terms.to_pylist()]
        step = max(1, (1 << 21) // s)
        for a in range(0, len(terms), step):
            part = trie.part(a, min(a + step, len(terms)))
            counts = np.zeros((len(part.terms), s), np.int64)
            counts[part.leaf, part.group] = part.n
            p, q = _shares(counts, whole), _shares(counts.sum(1), of_lang)
            for i in range(first, last):
                total[i - first] += np.abs(p[:, i : i + 1] - p).sum(0)
                over = np.where(counts[:, i] > 0, p[:, i] - q, 0)
                some = np.flatnonzero(over > 0)
                # Leaves come in the order of UTF-8, so a stable sort keeps ties in it.
                some = some[np.argsort(-over[some], kind="stable")[: settings.top]]
                if len(some):
                    new = [(-int(over[k]), terms[a + k].encode()) for k in some]
                    best[lang, i] = heapq.nsmallest(settings.top, best.get((lang, i), []) + new)
    for (lang, first), total in sums.items():
        for i in range(total.shape[0]):
            for j, value in enumerate(total[i].tolist()):
                if j != first + i:
                    yield {"lang": lang, "source": names[lang][first + i], "part": "pair", "item": names[lang][j], "value": value}
    for (lang, i), found in best.items():
        for value, term in found:
            yield {"lang": lang, "source": names[lang][i], "part": "term", "item": term.decode(), "value": -value}


def audit(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value and rank: how each source differs from the others of its language, and its words.

    part ``pair``: item is another source of the language, value the sum of the differences of the shares of
    all kept terms (0 where none are kept). part ``term``: item is a kept term that has a greater share in
    the group than in the language, value by how much; the greatest ``settings.top``. Ranks go by value, the
    greatest first, ties by the UTF-8 of the item. Rows count as often as they occur; null texts, languages and
    sources count as empty ones, a text without terms makes its group known all the same; columns other than lang, source and text are
    ignored. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "divergence")
    tries = scratch.save(count_terms(documents, settings), "tries")
    kept = scratch.save(merged_terms(tries, settings), "kept")
    scratch.drop("tries")
    # One row for each group: the output has one for each two of a language, so this is the lesser by far.
    groups = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum("leaves").alias("v"))
    known = groups.join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = known.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g")).join(sizes, "lang", "left")
    known = known.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("g.source").alias("all"), F.col("g.n").alias("n"))
    known = scratch.save(known.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(settings.block)))), "groups")
    weight = known.agg(F.sum(F.size("all"))).first()[0] or 0
    pieces = kept.select("lang", "sources", "trie")
    none = known.where("v = 0").select("*", F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("binary").alias("trie"))
    found = pieces.join(small(known, weight), "lang").select(none.columns).unionByName(none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_score((r for b in batches for r in b.to_pylist()), settings), _FOUND_ARROW, 1 << 14)

    found = found.mapInArrow(run, _FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= settings.top))
