"""Two tokenizers of one text, aligned by their byte offsets.

The ends of the tokens of both sides cut a text into elementary intervals (``union1d``); each
belongs to one token of either side (``searchsorted``), so each is one overlap of two tokens.
Where tokens of both sides end, a group closes, and all pairs of its tokens are links. A batch
of texts is one such line of bytes, as both sides end where a text does.

Links of a document are kept as distinct pairs of ids with how often they occur. A task counts the
documents of each pair before the shuffle; the counts of the most frequent pairs, of a bounded
number, are then looked up in every task, and links of rarer pairs meet theirs in a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .pieces import ragged
from .storage import Scratch
from .textkernel import slices
from .tokenfile import WordCache, _byte_tokens

#: Bytes that a byte-level vocabulary writes as the character of their own number; the others, in order, are characters from 256 on.
_AS_THEY_ARE = (*range(33, 127), *range(161, 173), *range(174, 256))
#: A group with more pairs of tokens than this is reduced to distinct ids before its product is made.
_LARGE_GROUP = 1 << 14
#: Bytes of texts that are aligned at once (or one text), and words of either side that a process keeps.
_SLICE, _WORDS = 1 << 20, 1 << 19


@dataclass(frozen=True)
class Settings:
    looked_up: int = 1 << 20  #: pairs of ids whose counts are sent to every task, at most (16 bytes each)
    held: int = 1 << 22  #: pairs that a task holds before it sends their counts on


class Vocabulary:
    """The bytes of the tokens of one side, by id."""

    def __init__(self, parts: list[bytes]):
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.sizes(ids))]


class Sides:
    """Both tokenizers of a process, with caches of words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        chars = {chr(b): b for b in _AS_THEY_ARE}
        chars |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_AS_THEY_ARE)))}
        vocab = self.a.get_vocab(with_added_tokens=True)
        parts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            parts[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.a_bytes = Vocabulary(parts)
        self.a_cache = WordCache(lambda texts: [np.array(e.ids, np.uint32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], _byte_tokens(self.a), _WORDS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.b_cache = pieces.PieceCache(pieces.Model(b_path), pieces.Settings(dropout=0.0), _WORDS)

    @staticmethod
    def _equal(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of texts (bytes from at[i] on), whether their ids (from first[i] on) stand for them."""
        ends = np.concatenate([[0], np.cumsum(vocabulary.sizes(ids))])[first]
        same = np.diff(ends) == np.diff(at)
        got = vocabulary.joined(ids)
        if same.all():
            wrong = np.concatenate([[0], np.cumsum(got != want)])[at]
            return np.diff(wrong) == 0
        return np.array([s and np.array_equal(got[a:b], want[c:d]) for s, a, b, c, d in zip(same, ends[:-1], ends[1:], at[:-1], at[1:], strict=True)])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each text can be aligned, then ids and where each text's start, of either side; texts that can't have none.

        A text whose cached words don't give its bytes is encoded once more by the tokenizer itself.
        """
        full = np.diff(offsets) > 0
        spaced = np.insert(buf, offsets[:-1][full], np.uint8(32))
        at = offsets + np.concatenate([[0], np.cumsum(full)])
        a_ids, a_n = self.a_cache.ids(spaced, at)
        b_ids, b_first = self.b_cache.encode_texts(buf, offsets, np.zeros(len(full), np.uint64))
        sides = []
        # The model can't tell this character from a blank, so it never gives it back.
        blank = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
        good = full & (np.diff(np.concatenate([[0], np.cumsum(blank), [int(blank.sum())] * min(2, len(buf))])[offsets]) == 0)
        for vocabulary, ids, first, again in (
            (self.a_bytes, a_ids.astype(np.int64), np.concatenate([[0], np.cumsum(a_n)]), lambda t: self.a.encode(" " + t, add_special_tokens=False).ids),
            (self.b_bytes, b_ids.astype(np.int64), b_first, lambda t: self.b.encode(t)),
        ):
            odd = np.flatnonzero(~self._equal(vocabulary, ids, first, spaced, at) & full)
            own = [ids[x:y] for x, y in zip(first[:-1], first[1:], strict=True)] if len(odd) else []
            for i in odd.tolist():
                want = spaced[at[i] : at[i + 1]]
                own[i] = np.array(again(want[1:].tobytes().decode()), np.int64)
                good[i] &= np.array_equal(vocabulary.joined(own[i]), want)
            sides.append((np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])) if len(odd) else (ids, first))
        out = []
        for ids, first in sides:
            n = np.diff(first)
            out += [ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))])]
        return good, *out


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """The tokenizers of this process."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


@dataclass
class Aligned:
    """Groups of a line of bytes: the intervals, and the group of each token."""

    intervals: np.ndarray  #: ends of the elementary intervals
    a_owner: np.ndarray
    b_owner: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``union1d`` of two ascending arrays: a stable sort merges their two runs, which takes a fraction of the time."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.diff(both, prepend=-1) != 0]


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """Both arrays ascend and have the same last entry (or are empty)."""
    intervals = _union(a_ends, b_ends)
    a_owner, b_owner = np.searchsorted(a_ends, intervals), np.searchsorted(b_ends, intervals)
    closes = (a_ends[a_owner] == intervals) & (b_ends[b_owner] == intervals)
    group = np.cumsum(closes) - closes
    a_group, b_group = group[np.searchsorted(intervals, a_ends)], group[np.searchsorted(intervals, b_ends)]
    return Aligned(intervals, a_owner, b_owner, a_group, b_group, int(closes.sum()))


def _counted(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(ids, return_inverse=True)
    return keys, np.bincount(back, times, len(keys)).astype(np.int64)


def links(a_ids: np.ndarray, b_ids: np.ndarray, found: Aligned, doc_of_group: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, pairs (a * wide + b) and times of all links, distinct and in order."""
    n_a, n_b = np.bincount(found.a_group, minlength=found.groups), np.bincount(found.b_group, minlength=found.groups)
    b_start = np.cumsum(n_b) - n_b
    large = n_a * n_b > _LARGE_GROUP
    brief = np.flatnonzero(~large[found.a_group])
    g = found.a_group[brief]
    other = b_ids[ragged(b_start[g], n_b[g])]
    doc = [np.repeat(doc_of_group[g], n_b[g])]
    pair = [np.repeat(a_ids[brief], n_b[g]) * wide + other]
    times = [np.ones(len(other), np.int64)]
    a_start = np.cumsum(n_a) - n_a
    for k in np.flatnonzero(large).tolist():
        a, of_a = np.unique(a_ids[a_start[k] : a_start[k] + n_a[k]], return_counts=True)
        b, of_b = np.unique(b_ids[b_start[k] : b_start[k] + n_b[k]], return_counts=True)
        doc.append(np.full(len(a) * len(b), doc_of_group[k]))
        pair.append((a[:, None] * wide + b).ravel())
        times.append((of_a[:, None] * of_b).ravel())
    doc, pair, times = np.concatenate(doc), np.concatenate(pair), np.concatenate(times)
    by = np.lexsort((pair, doc))
    doc, pair, times = doc[by], pair[by], times[by]
    first = np.flatnonzero(np.diff(pair, prepend=-1) | np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
    return doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _written(a_ids: np.ndarray, b_ids: np.ndarray, found: Aligned, last_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all groups as bytes, the texts one after another, and the length of each token's part. last_group: whether a group is its text's last."""
    n_a, n_b = np.bincount(found.a_group, minlength=found.groups), np.bincount(found.b_group, minlength=found.groups)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    a_at = np.arange(len(a_ids)) + (np.cumsum(n_b) - n_b)[found.a_group]
    b_at = np.arange(len(b_ids)) + np.cumsum(n_a)[found.b_group]
    ids[a_at], ids[b_at] = a_ids, b_ids
    end = np.cumsum(n_a + n_b)
    mark[end - n_b - 1] = ord("|")
    mark[end - 1] = np.where(last_group, 0, ord(";"))
    digits, sizes = _digits(int(ids.max(initial=0)).bit_length())
    table, size = digits[ids], sizes[ids]
    table[np.arange(len(ids)), size] = mark
    return table[table != 0], size + (mark != 0)


@lru_cache(maxsize=4)
def _digits(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers below 2 ** bits, with zeros behind them, and how many there are."""
    texts = [str(i).encode() for i in range(1 << bits)]
    table = np.array(texts, f"S{len(texts[-1]) + 1}").view(np.uint8).reshape(len(texts), -1)
    return table, np.array([len(t) for t in texts])


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary, times binary"
_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of an array of fixed width as a binary column."""
    ends = first.astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def aligned_rows(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, the digest of the groups and the distinct links of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(a_path, b_path)
        wide = len(s.b_bytes.at) - 1
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch, "text", _SLICE):
                good, a_ids, a_first, b_ids, b_first = s.encode(buf, offsets)
                found = align(np.cumsum(s.a_bytes.sizes(a_ids)), np.cumsum(s.b_bytes.sizes(b_ids)))
                n = hi - lo
                # Where each text's groups and intervals end: with its last token.
                last = lambda of, first: np.where(np.diff(first) > 0, of[np.maximum(first[1:], 1) - 1] + 1, 0) if len(of) else np.zeros(n, np.int64)
                group_end = np.maximum.accumulate(last(found.a_group, a_first))
                ends_at = np.maximum.accumulate(last(np.searchsorted(found.intervals, np.cumsum(s.a_bytes.sizes(a_ids))), a_first))
                doc_of_group = np.searchsorted(group_end, np.arange(found.groups), "right")
                is_last = np.zeros(found.groups, bool)
                is_last[group_end[good] - 1] = True
                text, sizes = _written(a_ids, b_ids, found, is_last)
                cut = np.concatenate([[0], np.cumsum(sizes)])[a_first + b_first]
                shas = [hashlib.sha256(text[x:y]).hexdigest() if g else "" for g, x, y in zip(good.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                doc, pair, times = links(a_ids, b_ids, found, doc_of_group, wide)
                first = np.searchsorted(doc, np.arange(n + 1))
                n_links = np.bincount(doc, times, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
                numbers = (np.diff(a_first), np.diff(b_first), np.diff(group_end, prepend=0), n_links, np.diff(ends_at, prepend=0))
                columns = [batch.column(0).slice(lo, n), *(pa.array(x, pa.int64()) for x in numbers), pa.array(shas, pa.string()), _binary(pair.astype("<i8"), first), _binary(times.astype("<i8"), first)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return rows.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pair and n, the documents that hold it linked; summed in each task first."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def fold() -> None:
            nonlocal keys, counts, held
            k, n = _counted(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [n], len(k)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], schema=schema)

        for batch in batches:
            for value in batch.column(0):
                keys.append(np.frombuffer(value.as_buffer(), "<i8").copy())
                counts.append(np.ones(len(keys[-1])))
                held += len(keys[-1])
                if held > 2 * settings.held:
                    fold()
                    if held > settings.held:
                        yield out()
                        keys, counts, held = [], [], 0
        if held:
            fold()
            yield out()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs are in as many documents."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("pairs")).collect()  # a row for each power of two
    power, pairs = 62, 0
    for r in sorted(sizes, key=lambda r: -r["k"]):
        pairs += r["pairs"]
        if pairs > most:
            break
        power = r["k"]
    else:
        return 1
    return 1 << power


def alignment(documents: DataFrame, a_path: str, b_path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row of ``documents`` (doc_id, text).

    a_path: a byte-level BPE file of the tokenizers library, which encodes a blank and the text; b_path: a
    SentencePiece model that puts a blank first by itself. Strings of special tokens are plain text. A text that is null
    or empty, or that one of the sides doesn't give back byte by byte, has no tokens: zeros, and '' for the digest. Every
    row is a document, repeated rows and rows with a null doc_id too. Other columns are ignored; an empty table gives an empty table.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.save(aligned_rows(documents, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = scratch.save(pair_counts(rows, settings), "counts")
    s = sides(a_path, b_path)
    wide, ids = len(s.b_bytes.at) - 1, len(s.a_bytes.at) - 1
    # The greatest count of each id of A: at most as many rows as the vocabulary.
    best = np.zeros(ids, np.int64)
    for r in counts.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]
    least = _frequent(counts, settings.looked_up)
    known = counts.where(F.col("n") >= least).toArrow()  # at most settings.looked_up rows
    pairs, n = (known.column(c).to_numpy() for c in ("pair", "n"))
    by = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[by], n[by], best))
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        keys, n = np.append(keys, np.iinfo(np.int64).max), np.append(n, 0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pair, times = ([np.frombuffer(v.as_buffer(), "<i8") for v in part.column(k)] for k in (1, 2))
                first = np.concatenate([[0], np.cumsum([len(p) for p in pair])])
                pair, times = np.concatenate(pair), np.concatenate(times)
                where = np.searchsorted(keys, pair)
                hit = keys[where] == pair
                count = np.where(hit, n[where], 0)
                top = np.where(hit & (count == best[pair // wide]), times, 0)
                total = lambda x, f=first: np.diff(np.concatenate([[0], np.cumsum(x)])[f])
                rest = np.concatenate([[0], np.cumsum(~hit)])[first]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total(top)), pa.array(total(count * times)), _binary(pair[~hit], rest), _binary(times[~hit], rest)], schema=schema)

    scored = rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs binary, times binary")
    if least > 1:
        scored = scratch.save(scored, "scored")
        scored = scored.select("row", "n_best", "count_sum").unionByName(_rare(scored, counts.where(F.col("n") < least), best, wide))
    else:
        scored = scored.select("row", "n_best", "count_sum")
    total = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def _rare(scored: DataFrame, counts: DataFrame, best: np.ndarray, wide: int) -> DataFrame:
    """The same of links that were not looked up: a row for each, joined with the counts. No pair has as many rows as one that was looked up."""
    spark = scored.sparkSession
    schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
    sent = spark.sparkContext.broadcast(best)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                pair = np.frombuffer(pairs.as_buffer(), "<i8")
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(np.frombuffer(times.as_buffer(), "<i8"))], schema=schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times, n = (batch.column(k).to_numpy() for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.where(n == sent.value[pair // wide], times, 0)), pa.array(n * times)], names=["row", "n_best", "count_sum"])

    each = scored.select("row", "pairs", "times").mapInArrow(unpack, "row long, pair long, times long")
    return each.join(counts.hint("merge"), "pair").select("row", "pair", "times", "n").mapInArrow(judge, "row long, n_best long, count_sum long")
