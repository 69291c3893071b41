"""Byte-level text kernels shared by the operators of this subpackage.

A batch of texts is one buffer of UTF-8 bytes with offsets, as Arrow lays it out.
Words are found and hashed with whole-buffer numpy operations: no Python loop runs
over words. Slices of a few MB keep the temporary arrays small however many rows a
batch has; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``[^\x20\x09-\x0D]+``: bytes that end a word.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SLICE_BYTES = 2 << 20
#: Places of a span that have a key in the table; further ones have theirs computed.
_PLACES = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def keyed(x: np.ndarray | int, seed: int) -> np.ndarray:
    """A hash of 64-bit integers under a seed."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(x + np.uint64(seed % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))


_TABLE = keyed(np.arange(_PLACES + 1), 0x5EED)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most ``most`` bytes, or of one row. Null is empty.

    lower: letters of all scripts in lower case.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    col = pc.utf8_lower(col) if lower else col
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (and one entry more)."""
    inside = ~ends_word[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _place_keys(places: np.ndarray) -> np.ndarray:
    """A 64-bit key for each place in a span."""
    out = _TABLE[np.minimum(places, _PLACES)]
    far = np.flatnonzero(places >= _PLACES)
    out[far] = keyed(places[far], 0x5EED)
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (in order, none within another): the sum of its bytes, each times a key of its place.

    The keys have no relation to one another as the powers of a base have, so no pattern of letters cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    places = np.arange(len(buf)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(buf)]])))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _place_keys(places), out=total[1:])
        return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one sequence; callers drop those that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
        return mix(h)


def room(first_word: np.ndarray) -> np.ndarray:
    """For each word, how many words of its text stand from it to the end."""
    counts = np.diff(first_word)
    return np.repeat(first_word[1:], counts) - np.arange(first_word[0], first_word[-1])
