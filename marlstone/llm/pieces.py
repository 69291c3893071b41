"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Encoding follows the agenda of BPE: of all neighbouring symbols whose union is a piece, the
best-scored (leftmost of equal ones) is merged, until none is left. With dropout each candidate
merge is skipped for good if a keyed hash of it falls below the rate. The key is made of the
seed, the word, the document, the word's place in it and the candidate's span, so a run can be
repeated exactly on any cluster, while every occurrence of a word draws for itself.

No piece goes on after white space, so a text falls into words (with the blanks before them)
that are encoded each by itself. What is looked up are runs of a word under a given set of
skipped candidates: their ids and all candidates that came up. An occurrence starts at the run
that skips none and tests the candidates under its own key; if it skips some of them, it goes on
to the run without these, until a run has no further candidate that it skips. That run is its
own: all choices in it are those of its key. Runs that are not known yet are merged together,
one merge a step for all of them, in numpy; very long words go through a heap, each occurrence.

Decoding puts the pieces' texts together. It gives back every text exactly, also unknown
characters (by bytes) and the blank sign itself, which is always taken by bytes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import hash_spans, keyed, mix, slices
from .tokenfile import WordCache

_BLANK = "▁"
_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Settings:
    """dropout: rate of skipped candidates. longest: symbols of a word that numpy takes. looked_up: symbols of a word whose runs are kept."""

    seed: int = 29
    dropout: float = 0.1
    longest: int = 48
    looked_up: int = 6


class Model:
    """Pieces of a SentencePiece BPE model: what merges to what, and what each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        ids = {names[i]: i for i in range(n) if normal[i]}
        if any(_BLANK in p.lstrip(_BLANK) for p in ids):
            raise ValueError("pieces go on after white space; words can't be encoded one by one")
        self.size = n
        self.char = np.full(0x110000, -1, np.int32)
        symbols = dict(ids)
        for p in ids:
            for c in p:  # characters that are no piece by themselves still merge
                symbols.setdefault(c, len(symbols) + n)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(" " if c == _BLANK else c)] = i
        self.bytes = np.full(256, sp.unk_id(), np.int64)
        parts = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][3:5], 16)
                self.bytes[value] = i
                parts[i] = bytes([value])
            elif normal[i]:
                parts[i] = names[i].replace(_BLANK, " ").encode()
        self.part_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.parts = np.frombuffer(b"".join(parts), np.uint8)
        # (left, right) -> piece; open addressing over a table of at least four times the entries.
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.shift = 64 - max(4, int(len(pairs) * 4).bit_length())
        table = 1 << (64 - self.shift)
        self.table_key, self.table_piece = np.full(table + 64, -1, np.int64), np.full(table + 64, -1, np.int32)
        slots = self._slot(np.array(list(pairs), np.int64)) if pairs else []
        for (key, piece), slot in zip(pairs.items(), slots, strict=True):
            while self.table_key[slot] >= 0:
                slot += 1
            self.table_key[slot], self.table_piece[slot] = key, piece
        self.rank = np.array([min(-sp.get_score(i), 2e9) if normal[i] else 2e9 for i in range(n)]).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each two symbols, or -1."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) << 20 | right[todo]
        slot = self._slot(key)
        while len(todo):
            seen = self.table_key[slot]
            hit = seen == key
            out[todo[hit]] = self.table_piece[slot[hit]]
            on = ~hit & (seen >= 0)
            todo, key, slot = todo[on], key[on], slot[on] + 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, without the blank that encoding puts first."""
        size = np.diff(self.part_at)[ids]
        total = np.cumsum(size)
        if not len(ids):
            return b""
        take = np.arange(total[-1]) + np.repeat(self.part_at[ids] - total + size, size)
        return self.parts[take].tobytes()[1:]


def span_codes(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the candidate that joins the symbols start to middle and middle to end of a word."""
    with np.errstate(over="ignore"):
        return mix(start.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + middle.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + end.astype(np.uint64))


def skipped(key: np.ndarray, codes: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates of these codes are skipped under the keys."""
    if rate <= 0:
        return np.zeros(np.shape(codes), bool)
    with np.errstate(over="ignore"):
        return mix(key + codes) >> np.uint64(11) < np.uint64(rate * (1 << 53))


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at, at + 1 and so on, size of them, for all one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + size, size)


#: Of the candidates of words (numbers, codes), those that are skipped.
Skip = Callable[[np.ndarray, np.ndarray], np.ndarray]


def merge_together(model: Model, symbols: np.ndarray, lengths: np.ndarray, words: np.ndarray, skip: Skip) -> np.ndarray:
    """Merges all words (rows of symbols, padded) in step; returns the symbols, -2 where one was merged into its left."""
    n, width = symbols.shape
    out = np.full((n, width), -2, np.int32)
    alive = np.arange(n)
    place = np.arange(width)
    s = symbols.copy()
    ends = np.minimum(place + 1, lengths[:, None])  # where the symbol that starts here ends
    before = np.broadcast_to(place - 1, (n, width)).copy()
    best = np.full((n, width), _NONE, np.int32)
    piece = np.full((n, width), -1, np.int32)
    s[place >= lengths[:, None]] = -2
    row, left = np.nonzero(place[None, :] + 1 < lengths[:, None])

    def consider(row: np.ndarray, left: np.ndarray) -> None:
        right = ends[row, left]
        m = model.merged(s[row, left], s[row, right])
        rank = np.where(m >= 0, model.rank[m], _NONE)
        can = np.flatnonzero(m >= 0)
        drop = skip(words[row[can]], span_codes(left[can], right[can], ends[row[can], right[can]]))
        rank[can[drop]] = _NONE
        best[row, left], piece[row, left] = rank, m

    consider(row, left)
    while True:
        at = best.argmin(1)
        go = best[np.arange(len(at)), at] < _NONE
        if not go.all():
            done = np.flatnonzero(~go)
            out[alive[done]] = s[done]
            live = np.flatnonzero(go)
            if not len(live):
                return out
            alive, s, ends, before, best, piece, lengths, words, at = alive[live], s[live], ends[live], before[live], best[live], piece[live], lengths[live], words[live], at[live]
        row = np.arange(len(at))
        right = ends[row, at]
        after = ends[row, right]
        s[row, at] = piece[row, at]
        s[row, right] = -2
        best[row, right] = best[row, at] = _NONE
        ends[row, at] = after
        more = np.flatnonzero(after < lengths)
        before[more, after[more]] = at[more]
        consider(more, at[more])
        back = before[row, at]
        more = np.flatnonzero(back >= 0)
        consider(more, back[more])


def merge_one(model: Model, symbols: np.ndarray, word: int, skip: Skip) -> np.ndarray:
    """The same for one word of any length, with a heap as the agenda."""
    n = len(symbols)
    s, ends, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple] = []

    def consider(left: np.ndarray) -> None:
        right = np.array([ends[x] for x in left])
        last = np.array([ends[x] for x in right])
        m = model.merged(np.array([s[x] for x in left]), np.array([s[x] for x in right]))
        can = np.flatnonzero(m >= 0)
        can = can[~skip(np.full(len(can), word), span_codes(left[can], right[can], last[can]))]
        for x, y, z, p in zip(left[can].tolist(), right[can].tolist(), last[can].tolist(), m[can].tolist(), strict=True):
            heapq.heappush(agenda, (int(model.rank[p]), x, y, z, p))

    if n > 1:
        consider(np.arange(n - 1))
    while agenda:
        _, x, y, z, p = heapq.heappop(agenda)
        if s[x] == -2 or ends[x] != y or s[y] == -2 or ends[y] != z:
            continue
        s[x], s[y], ends[x] = p, -2, z
        if z < n:
            before[z] = x
            consider(np.array([x]))
        if before[x] >= 0:
            consider(np.array([before[x]]))
    return np.array(s, np.int32)


class PieceCache(WordCache):
    """Runs of words by the word and what was skipped: ids, and codes of the candidates that came up."""

    def __init__(self, model: Model, settings: Settings, most: int = 1 << 21):
        self.model, self.settings, self.most = model, settings, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.codes = np.zeros(0, np.uint64)
        self.codes_at = np.zeros(0, np.int64)
        self.codes_size = np.zeros(0, np.int64)

    def merge(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skip: Skip) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word (code points, the blank as itself), and all ids."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.cumsum(lengths) - lengths
        chars = points[ragged(starts, lengths)]
        symbols = self.model.char[chars]
        by = np.argsort(lengths, kind="stable")
        sorted_lengths = lengths[by]
        at = int(np.searchsorted(sorted_lengths, 1, "right"))  # one symbol is as it is
        while at < len(by):
            width = int(sorted_lengths[at])
            if width > self.settings.longest:
                i = int(by[at])
                own = slice(first[i], first[i] + width)
                symbols[own] = merge_one(self.model, symbols[own], i, skip)
                at += 1
                continue
            width = -(-width // 4) * 4
            stop = min(int(np.searchsorted(sorted_lengths, width, "right")), at + 16384)
            part = by[at:stop]
            n = lengths[part]
            rows = np.full((len(part), width), -2, np.int32)
            inside = np.arange(width) < n[:, None]
            own = ragged(first[part], n)
            rows[inside] = symbols[own]
            symbols[own] = merge_together(self.model, rows, n, part, skip)[inside]
            at = stop
        kept = symbols != -2
        size = kept.astype(np.int64)
        odd = np.flatnonzero(kept & ((symbols < 0) | (symbols >= self.model.size)))
        spelt = [chr(c).encode() for c in chars[odd].tolist()]
        size[odd] = [len(x) for x in spelt]
        ids = np.repeat(symbols, size).astype(np.int64)
        if len(odd):
            ids[ragged((np.cumsum(size) - size)[odd], size[odd])] = self.model.bytes[np.frombuffer(b"".join(spelt), np.uint8)]
        return np.add.reduceat(size, first), ids

    def segment(self, words: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word under its key, and all ids."""
        lengths = np.array([len(w) for w in words], np.int64)
        return self.merge(np.concatenate(words), np.cumsum(lengths) - lengths, lengths, self._own(keys))

    def _own(self, keys: np.ndarray) -> Skip:
        return lambda word, codes: skipped(keys[word], codes, self.settings.dropout)

    def _add(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: np.ndarray, code: np.ndarray) -> None:
        """Makes runs known: each of a word without the candidates given for it (numbers of words, codes)."""
        names = mix(np.arange(len(keys), dtype=np.uint64))
        without = np.unique(names[word] ^ code)
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def skip(word: np.ndarray, codes: np.ndarray) -> np.ndarray:
            if self.settings.dropout <= 0:
                return np.zeros(len(codes), bool)
            drop = np.zeros(len(codes), bool)
            if len(without):
                pair = names[word] ^ codes
                where = np.searchsorted(without, pair)
                drop = without[np.minimum(where, len(without) - 1)] == pair
            seen.append((word[~drop], codes[~drop]))
            return drop

        sizes, ids = self.merge(points, starts, lengths, skip)
        of = np.concatenate([x for x, _ in seen]) if seen else np.zeros(0, np.int64)
        codes = np.concatenate([x for _, x in seen]) if seen else np.zeros(0, np.uint64)
        count = np.bincount(of, minlength=len(keys))
        codes = codes[np.argsort(of, kind="stable")]
        by = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.codes_at = np.concatenate([self.codes_at, len(self.codes) + np.cumsum(count) - count])[by]
        self.codes_size = np.concatenate([self.codes_size, count])[by]
        self.codes = np.concatenate([self.codes, codes])
        self.learn(keys, sizes, ids)

    def encode_texts(self, buf: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's start (and the end)."""
        full = offsets[1:] > offsets[:-1]
        if not full.any():
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        points = np.insert(points, chars[:-1][full], np.uint32(32))
        first = chars + np.concatenate([[0], np.cumsum(full)])
        start = np.zeros(len(points), bool)
        start[1:] = (points[1:] == 32) & (points[:-1] != 32) | (points[1:] == 10) | (points[:-1] == 10)
        start[first[:-1][full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        chunk = np.searchsorted(starts, first)
        number = np.arange(len(starts)) - np.repeat(chunk[:-1], np.diff(chunk))
        with np.errstate(over="ignore"):
            run = hash_spans(points, starts, ends)
            keys = mix(run + keyed(np.repeat(doc_keys, np.diff(chunk)) + number.astype(np.uint64), self.settings.seed))
        size, at, pool = self.runs(points, starts, ends - starts, run, keys)
        return pool[ragged(at, size)], np.concatenate([[0], np.cumsum(size)])[chunk]

    def runs(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, run: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each word under its key, where they start, and the pool that they are in. run: hashes of the words."""
        if len(self.keys) > self.most:
            self.clear()
        rate = self.settings.dropout
        size, at = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        brief = lengths <= self.settings.looked_up if rate > 0 else np.ones(len(starts), bool)
        todo, run = np.flatnonzero(brief), run[brief]
        left_out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            asked, one, back = np.unique(run, return_index=True, return_inverse=True)
            where = np.searchsorted(self.keys, asked)
            known = where < len(self.keys)
            known[known] = self.keys[where[known]] == asked[known]
            if not known.all():
                new = todo[one[~known]]
                number = np.full(len(starts), -1)
                number[new] = np.arange(len(new))
                own = [(number[w][number[w] >= 0], c[number[w] >= 0]) for w, c in left_out]
                word, code = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                self._add(asked[~known], points, starts[new], lengths[new], word, code)
                where = np.searchsorted(self.keys, asked)
            where = where[back]
            size[todo], at[todo] = self.size[where], self.at[where]
            count = self.codes_size[where]
            codes = self.codes[ragged(self.codes_at[where], count)]
            hit = np.flatnonzero(skipped(np.repeat(keys[todo], count), codes, rate))
            if not len(hit):
                break
            of, codes = np.searchsorted(np.cumsum(count), hit, "right"), codes[hit]
            left_out.append((todo[of], codes))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            on = of[first]
            with np.errstate(over="ignore"):
                run = mix(run[on] + np.add.reduceat(mix(codes), first))
            todo = todo[on]
        long = np.flatnonzero(~brief)
        size[long], ids = self.merge(points, starts[long], lengths[long], self._own(keys[long]))
        at[long] = len(self.pool) + np.cumsum(size[long]) - size[long]
        return size, at, np.concatenate([self.pool, ids.astype(np.uint32)]) if len(long) else self.pool


_caches: dict[tuple, PieceCache] = {}
_COLUMNS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_crc32": T.LongType(), "decoded": T.StringType(), "decoded_crc32": T.LongType(), "lossless": T.BooleanType()}


def encode(documents: DataFrame, model_path: str, settings: Settings = Settings(), columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and the asked columns for every row of ``documents`` (doc_id, text; other columns are ignored).

    columns: ids; n_tokens; ids_crc32 (of the ids as little-endian unsigned 32-bit integers);
    decoded (the text that the ids give back), decoded_crc32 (of its UTF-8), lossless (whether
    it is the text). A null or empty text has no ids and decodes to the empty text. Dropout is
    keyed by doc_id and place; rows with a null doc_id count as id 0.
    """
    fields = [T.StructField("doc_id", T.LongType()), *(T.StructField(c, _COLUMNS[c]) for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, settings)
        if key not in _caches:
            _caches[key] = PieceCache(Model(model_path), settings)
        cache = _caches[key]
        for batch in batches:
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, buf, offsets in slices(batch, "text", 1 << 20):
                ids, first = cache.encode_texts(buf, offsets, keyed(doc_ids[lo:hi], settings.seed + 2))
                data = buf.tobytes()
                made: dict[str, list] = {c: [] for c in columns if c != "ids"}
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = ids[a:b]
                    if "n_tokens" in made:
                        made["n_tokens"].append(b - a)
                    if "ids_crc32" in made:
                        made["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                    if {"decoded", "decoded_crc32", "lossless"} & set(columns):
                        text = cache.model.decode(own)
                        if "decoded" in made:
                            made["decoded"].append(text.decode())
                        if "decoded_crc32" in made:
                            made["decoded_crc32"].append(zlib.crc32(text))
                        if "lossless" in made:
                            made["lossless"].append(text == data[offsets[i] : offsets[i + 1]])
                types = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "decoded": pa.string(), "decoded_crc32": pa.int64(), "lossless": pa.bool_()}
                arrays = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))) if c == "ids" else pa.array(made[c], types[c]) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *arrays], names=["doc_id", *columns])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """Adds ``text`` to rows with a column ``ids``, in place of any of that name; null ids give a null text."""
    kept = [c for c in tokens.columns if c != "text"]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts = [None if not x.is_valid else model.decode(x.values.to_numpy()).decode() for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return tokens.select(*kept).mapInArrow(run, schema)
