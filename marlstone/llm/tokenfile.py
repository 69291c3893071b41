"""Token ids in directly addressable codes: binary files that give any token without decoding a block.

An id is cut into 8-bit chunks, the lowest first. Level 0 holds the first chunk of every id;
a bitmap says for each whether the id goes on, and level 1 holds the second chunk of those
only, with a bitmap of its own, and so on. A rank directory (the number of set bits before
each 512-bit block) turns a place in one level into a place in the next with one look-up and
a population count of at most eight words. So one token costs a step for each of its bytes,
wherever it stands.

File layout, little-endian: magic ``MDAC0002``; unsigned 64-bit counts of documents, tokens
and levels; for each document its id (signed 64-bit); a bitmap in 64-bit words of the documents
without an id; for each document, with one entry more, the place of its first token
(unsigned 64-bit); for each level its length, its chunks (padded to 8 bytes),
its bitmap in 64-bit words, and its rank directory (unsigned 64-bit). The last level has
neither bitmap nor directory.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch
from .textkernel import hash_spans, slices

MAGIC = b"MDAC0002"
_BLOCK = 512


def _bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits in 64-bit words, whole blocks of them, and the rank directory."""
    n = -(-max(len(bits), 1) // _BLOCK) * _BLOCK
    padded = np.zeros(n, np.uint8)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    counts = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(1, dtype=np.uint64)
    return words, np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])


def _flags(bits: np.ndarray) -> bytes:
    """Bits in whole 64-bit words."""
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").tobytes()


def encode_file(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, unnamed: np.ndarray | None = None) -> bytes:
    """The file of documents whose tokens are ``ids[first[i]:first[i + 1]]``; unnamed: which of them have no id."""
    unnamed = np.zeros(len(doc_ids), bool) if unnamed is None else unnamed
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more]
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), np.where(unnamed, 0, doc_ids).astype("<i8").tobytes(), _flags(unnamed), first.astype("<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), b"\0" * (-len(chunk) % 8)]
        if k + 1 < len(levels):
            words, ranks = _bitmap(more)
            out += [struct.pack("<QQ", len(words), len(ranks)), words.astype("<u8").tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """A file of :func:`encode_file`; nothing is decoded until asked for."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        flags = np.frombuffer(data, np.uint8, -(-docs // 64) * 8, at)
        self.unnamed = np.unpackbits(flags, bitorder="little")[:docs].astype(bool)
        at += len(flags)
        self.first = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words = ranks = None
            if k + 1 < n_levels:
                a, b = struct.unpack_from("<QQ", data, at)
                words = np.frombuffer(data, "<u8", a, at + 16)
                ranks = np.frombuffer(data, "<u8", b, at + 16 + 8 * a)
                at += 16 + 8 * (a + b)
            self.levels.append((chunk, words, ranks))

    def _rank(self, words: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        word = i >> 6
        r = int(ranks[i // _BLOCK])
        start = i // _BLOCK * (_BLOCK // 64)
        r += int(np.bitwise_count(words[start:word]).sum()) if word > start else 0
        return r + (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else r

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunk, words, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                return value
            i, shift = self._rank(words, ranks, i), shift + 8
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        shift = 0
        for chunk, words, ranks in self.levels:
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            if words is None or a == b:
                break
            bits = np.unpackbits(words[a >> 6 : (b + 63) >> 6].view(np.uint8), bitorder="little")[a & 63 : (a & 63) + b - a].view(bool)
            a = self._rank(words, ranks, a)
            at = at[bits]
            b, shift = a + len(at), shift + 8
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.first[i]), int(self.first[i + 1]))


class WordCache:
    """Ids of texts by way of their distinct chunks: white space with the word after it.

    The byte-level pattern never joins what stands before white space with what follows it:
    every alternative but the white-space ones ends before white space, and a run of white
    space (with the blank that a word takes along) depends on that run and the character
    after it alone. So a text can be cut before each run of white space that follows another
    character, and equal chunks have equal ids. A chunk is encoded once and then found by
    its 64-bit hash. Cuts are made only before a blank or line feed and after a character
    that no definition takes for white space.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], token_bytes: np.ndarray, most: int = 1 << 21):
        self.encode, self.token_bytes, self.most = encode, token_bytes, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    @staticmethod
    def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of all chunks, those of the texts that are not empty among them."""
        plain = buf > 0x20
        plain[buf == 0x7F] = False
        high = buf >= 0x80
        wide = np.zeros(len(buf), bool)  # the end of a character that might be white space
        if len(buf) > 1:
            wide[1:] |= high[1:] & (buf[:-1] == 0xC2)
            wide[2:] |= high[2:] & ((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
        start = np.zeros(len(buf), bool)
        start[1:] = ((buf[1:] == 0x20) | (buf[1:] == 0x0A)) & (plain & ~wide)[:-1]
        start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(start)

    def _add(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes chunks that are not known yet, many in one call: their ids are cut apart by the bytes they stand for."""
        # Chunks that begin with a blank or line feed can follow one another; others are encoded by themselves.
        joins = (buf[starts] == 0x20) | (buf[starts] == 0x0A)
        tail = buf[ends - 1]
        joins &= (tail > 0x20) & (tail < 0x7F)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n_joined = int(joins.sum())
        data = buf.tobytes()
        texts, groups = [], []
        for lo in range(0, n_joined, 4096):
            part = order[lo : min(lo + 4096, n_joined)]
            texts.append(b"".join([data[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]).decode())
            groups.append(part)
        for i in order[n_joined:]:
            texts.append(data[starts[i] : ends[i]].decode())
            groups.append(np.array([i]))
        sizes = np.zeros(len(keys), np.int64)
        ids = self.encode(texts)
        for part, got in zip(groups, ids, strict=True):
            if len(part) == 1:
                sizes[part[0]] = len(got)
                continue
            ends_at = np.cumsum(self.token_bytes[got])
            want = np.cumsum(ends[part] - starts[part])
            cut = np.searchsorted(ends_at, want) + 1
            if not np.array_equal(ends_at[cut - 1], want):
                raise RuntimeError("a token stands across a chunk's end")
            sizes[part] = np.diff(cut, prepend=0)
        self.learn(keys[order], sizes[order], np.concatenate(ids))

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.cuts(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        per_chunk, ids = self.resolve(hash_spans(buf, starts, ends), lambda keys, new: self._add(keys, buf, starts[new], ends[new]))
        return ids, np.diff(per_chunk[np.searchsorted(starts, offsets)])

    def resolve(self, h: np.ndarray, add: Callable[[np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk start, and all ids; add(keys, chunks) makes those that are not known yet known."""
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        where = np.searchsorted(self.keys, keys)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == keys[known]
        if not known.all():
            add(keys[~known], one[~known])
            where = np.searchsorted(self.keys, keys)
        size, at = self.size[where][back], self.at[where][back]
        total = np.cumsum(size)
        take = np.arange(total[-1]) + np.repeat(at - total + size, size)
        return np.concatenate([[0], total]), self.pool[take]

    def learn(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds chunks with so many ids each, one after another."""
        at = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        merged = np.concatenate([self.keys, keys])
        by = np.argsort(merged, kind="stable")
        self.keys = merged[by]
        self.at = np.concatenate([self.at, at])[by]
        self.size = np.concatenate([self.size, sizes])[by]


def _byte_tokens(tokenizer) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for (one character of a token for each byte)."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        lengths[i] = len(token)
    return lengths


_caches: dict[str, WordCache] = {}


def byte_bpe_cache(path: str) -> WordCache:
    """The cache of this process for a byte-level BPE file of the tokenizers library.

    A special token's string in a text is that token, as in the library's own call: it has no
    white space, so it stands inside one chunk, and what stands before and after it is cut
    where it is in the whole text.
    """
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        _caches[path] = WordCache(encode, _byte_tokens(tokenizer))
    return _caches[path]


def write_file(uri: str, data: bytes) -> None:
    """Writes under another name and renames: a reader never sees half a file, and a repeated task replaces its own."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    try:
        fs.move(temporary, path)
    except OSError:  # some stores don't rename over a file that an earlier try of the task has left
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(path)
        fs.move(temporary, path)


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, partitions: int | None = None, file_tokens: int = 1 << 23) -> list[dict]:
    """Writes the ids of all texts in ascending doc_id order; returns the manifest, one entry for each file.

    A null text has no ids but the end id; rows with a null doc_id come first, marked in the
    file as having none. An empty table gives a manifest without files. Rows with equal ids follow one another in the order of their
    texts. A file holds whole documents, and a new one begins after ``file_tokens`` tokens, so
    memory stays bounded however large a partition is (but for one text longer than that).
    """
    spark = documents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = byte_bpe_cache(tokenizer_path)
        part, k = TaskContext.get().partitionId(), 0
        docs, missing, counts, parts, held = [], [], [], [], 0
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal docs, missing, counts, parts, held, k
            first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            name = f"tokens-{part:06d}-{k:05d}.dac"
            write_file(f"{folder}/{name}", encode_file(np.concatenate(docs), first, np.concatenate(parts), np.concatenate(missing)))
            out = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(first) - 1], "n_tokens": [int(first[-1])]})
            docs, missing, counts, parts, held, k = [], [], [], [], 0, k + 1
            return out

        for batch in batches:
            doc_ids, unnamed = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in slices(batch, "text"):
                ids, n_ids = cache.ids(buf, offsets)
                ids = np.insert(ids, np.repeat(np.cumsum(n_ids), len(end)), np.tile(end, hi - lo))
                docs.append(doc_ids[lo:hi])
                missing.append(unnamed[lo:hi])
                counts.append(n_ids + len(end))
                parts.append(ids)
                held += len(ids)
                if held >= file_tokens:
                    yield flush()
        if docs:
            yield flush()

    # The manifest has one short row for each file of millions of tokens.
    files = sorted((r.asDict() for r in rows.mapInArrow(run, "name string, n_docs long, n_tokens long").collect()), key=lambda r: r["name"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["n_tokens"]
    write_file(f"{folder}/manifest.json", json.dumps(files).encode())
    return files


def read_tokens(spark, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and last_id of every document, from the files."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32", "last_id")])
    if not files:
        return spark.createDataFrame([], schema)
    manifest = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, first long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    content = content.join(F.broadcast(manifest), "name").select("content", "first")  # some 50 bytes for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(memoryview(data.as_buffer()))
                crc, last = [], []
                for i in range(len(file.doc_ids)):
                    ids = file.document(i)
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    last.append(int(ids[-1]) if len(ids) else -1)
                doc_ids = pa.array(file.doc_ids, pa.int64(), mask=file.unnamed)
                rest = (pa.array(x, pa.int64()) for x in (file.first[:-1] + first, np.diff(file.first), crc, last))
                yield pa.RecordBatch.from_arrays([doc_ids, *rest], names=[f.name for f in schema])

    return content.mapInArrow(run, schema)


def tokenize_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and returns what is read back from them."""
    scratch = Scratch(documents.sparkSession, "tokens")
    files = write_tokens(documents, scratch.path, tokenizer_path, end_id)
    return read_tokens(documents.sparkSession, scratch.path, files)
