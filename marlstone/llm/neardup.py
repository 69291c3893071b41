"""Near-duplicate documents: MinHash bands, odd sketches, and links confirmed on whole shingle sets.

1. Every text becomes the set of its distinct word shingles. Texts with the same set are one
   class, stood for by its smallest doc_id; from here on only these representatives count.
2. A representative gets MinHash samples; bands of samples are bucket keys. With each key goes
   an odd sketch: the samples folded into a bitmap by parity. The XOR of two bitmaps has about
   as many set bits as the samples differ, which tells high similarities apart precisely.
3. Within a bucket the sketches alone join members into families: each member in turn takes
   those not yet taken that are not far below the threshold. A tight bucket is joined by a
   few members, and at most one link for each member leaves it. Families are components of
   these links over all buckets, so every pair that may link is inside one family.
4. Within a family all pairs are decided on the full sets, in blocks: shingles that only one
   member has are only counted, the others form a small matrix whose products are the exact
   intersections. No pair leaves the task, only links enough to connect what is connected.
5. Components of the confirmed links give the result.

A bucket or family of many members is never one task. Its members are dealt to parts, and one
leader is sent to all of them (of a family: the member that is most like a few dozen others).
Whom the leader links with is connected already, so of the rest alone all pairs are looked at,
with each other and with the linked ones, each two parts in a task of their own.

Pairs that share no band are not found: at the threshold that is below one in a million pairs,
and above it less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, small
from .covertree import Links
from .storage import Scratch
from .textkernel import BLANKS, LOWER, grams, hash_spans, keyed, mix, slices, spans


@dataclass(frozen=True)
class Settings:
    """words: in a shingle. Link: ``100 * intersection >= percent * union``. bands, rows: of MinHash samples.

    margin: pairs whose sketches estimate a similarity further than this below the threshold don't join families
    (five standard deviations). part_rows: members of a part, about, up to 24 parts; larger families have larger parts, up to
    most_rows. part_shingles: of a part of a family, about. bucket_rows: of a bucket that one task takes, at most. samples_of: a
    family's members that its leader is chosen by, about.
    """

    words: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 4
    margin: float = 0.25
    part_rows: int = 128
    most_rows: int = 4096
    part_shingles: int = 1 << 22
    bucket_rows: int = 4096
    samples_of: int = 48
    seed: int = 23

    @property
    def samples(self) -> int:
        return self.bands * self.rows


_BITS = 256  # of an odd sketch


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of the rows from there): sorted distinct hashes of the k-word shingles of each lower-cased text.

    A text of fewer words is one shingle of all of them; one without words is empty.
    """
    for lo, hi, buf, offsets in slices(batch, "text"):
        buf = LOWER[buf]
        starts, ends, first = spans(buf, offsets, BLANKS)
        words = hash_spans(buf, starts, ends)
        runs = grams(words, k)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                out.append(grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield lo, out


def _hashers(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    h = keyed(np.arange(2 * s.samples), s.seed)
    return (h[: s.samples] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[s.samples :] >> np.uint64(32)).astype(np.uint32)


def _signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of the set under each hash function."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = None
    for i in range(0, len(low), 1024):
        part = (low[i : i + 1024, None] * a + b).min(0)
        out = part if out is None else np.minimum(out, part)
    return out


def _sign(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers(s)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, sets in shingle_sets(batch, s.words):
                with np.errstate(over="ignore"):
                    one = [int(mix(x).sum(dtype=np.uint64)) for x in sets]
                    two = [int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, len(sets)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(np.array(one, np.uint64).view(np.int64)),
                        pa.array(np.array(two, np.uint64).view(np.int64)),
                        pa.array([_signature(x, a, b).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set1", "set2", "samples"],
                )

    return run, "doc_id long, n_shingles long, set1 long, set2 long, samples binary"


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) of rows of MinHash samples."""
    n, k = samples.shape
    with np.errstate(over="ignore"):
        place = mix(samples.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.arange(k, dtype=np.uint64)) % np.uint64(_BITS)
    bits = np.bincount((place + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(_BITS)).ravel().astype(np.int64), minlength=n * _BITS) & 1
    return np.packbits(bits.reshape(n, _BITS).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def similarity(ones: np.ndarray, samples: int) -> np.ndarray:
    """The similarity that so many set bits in the XOR of two odd sketches tell of."""
    part = np.minimum(2 * ones / _BITS, 1 - 1e-9)
    return 1 - (-_BITS / 2 * np.log1p(-part)) / (2 * samples)


def _bands(s: Settings, sketched: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                samples = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(len(ids), s.samples)
                rows = samples.reshape(len(ids), s.bands, s.rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.tile(np.arange(1, s.bands + 1, dtype=np.uint64), (len(ids), 1))
                    for j in range(s.rows):
                        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, :, j])
                if not sketched:
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64))], names=["key"])
                    continue
                sketches = odd_sketches(samples)
                flat = pa.array([x.tobytes() for x in sketches], pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), s.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, s.bands)), flat], names=["key", "rep", "sketch"])

    return run, "key long, rep long, sketch binary" if sketched else "key long"


def whole_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, cut only between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1].column(column)[-1].as_py() != keys[0]:
            yield _joined(held)
            held = []
        if cut:
            yield _joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of at least two equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            yield a, b


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), _BITS // 64)


def _family_links(s: Settings):
    """Each member of a bucket in turn takes the members not yet taken that its sketch is near enough to."""
    low = s.percent / 100 - s.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            keys = batch.column(0).to_numpy()
            same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
            shared = same[:-1] | same[1:]
            if not shared.any():
                continue
            batch = batch.filter(pa.array(shared))
            keys, reps, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sketches(batch.column(2))
            one, two = [], []
            for a, b in _groups(keys):
                left = np.arange(a, b)
                while len(left):
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        u = front.pop()
                        near = similarity(np.bitwise_count(bits[left] ^ bits[u]).sum(1), s.samples) >= low
                        got, left = left[near], left[~near]
                        one.append(np.full(len(got), reps[u]))
                        two.append(reps[got])
                        front.extend(got.tolist())
            yield _pairs(one, two)

    return run


def _pairs(one: list, two: list) -> pa.RecordBatch:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (one, two))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch, s.words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "shingles"])

    return run, "rep long, shingles binary"


_CELL = "grp long, part long, side byte, rep long, load binary"


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of _CELL, the rows of each part of each group together."""
    return rows.withColumn("cell", F.xxhash64("grp", "part")).repartition("cell").sortWithinPartitions("cell", "grp", "part")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one part of one group after another."""
    for batch in whole_groups(batches, 5):
        grp, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (part[1:] != part[:-1]), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def _part_of(rep: str = "rep", parts: str = "parts") -> Column:
    return F.pmod(F.xxhash64(F.lit(31), rep), parts)


def _to_all(few: DataFrame) -> DataFrame:
    """A row for each part of its group, on the other side."""
    return few.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).cast("byte").alias("side"), "rep", "load")


def _own(rows: DataFrame) -> DataFrame:
    return rows.select("grp", _part_of().alias("part"), F.lit(0).cast("byte").alias("side"), "rep", "load")


def _likeness(s: Settings):
    """How like the other side's members (by their samples) each member is: grp, rep, score of the best one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            side, rep = part.column(2).to_numpy(), part.column(3).to_numpy()
            samples = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(len(rep), s.samples)
            own, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(own):
                continue
            score = np.zeros(len(own))
            for k in others.tolist():
                score += (samples[own] == samples[k]).mean(1)
            best = own[np.lexsort((rep[own], -score))[0]]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array(rep[best : best + 1]), pa.array([float(score.max())])], names=["grp", "rep", "score"])

    return run, "grp long, rep long, score double"


def _near_sketches(s: Settings):
    low = s.percent / 100 - s.margin

    def linked_with(leader: bytes, loads: list[bytes]) -> np.ndarray:
        bits = np.frombuffer(b"".join(loads), np.uint64).reshape(len(loads), _BITS // 64)
        return similarity(np.bitwise_count(bits ^ np.frombuffer(leader, np.uint64)).sum(1), s.samples) >= low

    return linked_with


def _like_sets(s: Settings):
    def linked_with(leader: bytes, loads: list[bytes]) -> np.ndarray:
        of, sets = np.frombuffer(leader, np.uint64), [np.frombuffer(x, np.uint64) for x in loads]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(of, every), len(of) - 1)
        both = np.add.reduceat(of[at] == every, np.cumsum(sizes) - sizes).astype(np.int64)
        return 100 * both >= s.percent * (sizes + len(of) - both)

    return linked_with


def _led(linked_with):
    """Every member with whether the leader (the other side's rows: one document's) links with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            side, rep = part.column(2).to_numpy(), part.column(3).to_numpy()
            own = np.flatnonzero(side == 0)
            if not len(own):
                continue
            members = part.take(pa.array(own))
            loads = members.column(4).to_pylist()
            ok, leader = np.zeros(len(own), bool), None
            for k in np.flatnonzero(side == 1).tolist():
                leader = int(rep[k])
                ok |= linked_with(part.column(4)[k].as_py(), loads) | (rep[own] == leader)
            leaders = pa.array([leader] * len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([members.column(0), members.column(3), members.column(4), leaders, pa.array(ok)], names=["grp", "rep", "load", "leader", "linked"])

    return run, "grp long, rep long, load binary, leader long, linked boolean"


def _pairs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for each two parts that a member has to be in. Parts of the rest come first; two parts of linked members need not meet."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            grp, rep, linked, rest_parts, linked_parts = (piece.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5))
            h = keyed(rep.view(np.uint64), 37)
            own = np.where(linked, rest_parts + (h % np.maximum(linked_parts, 1).astype(np.uint64)).astype(np.int64), (h % np.maximum(rest_parts, 1).astype(np.uint64)).astype(np.int64))
            copies = np.where(linked, rest_parts, rest_parts + linked_parts)
            row = np.repeat(np.arange(len(rep)), copies)
            other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            pair = np.minimum(own[row], other) << 31 | np.maximum(own[row], other)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grp[row]), pa.array(pair), pa.array((own[row] > other).astype(np.int8)), piece.column(1).take(rows), piece.column(2).take(rows)], names=["grp", "part", "side", "rep", "load"])


def _meet(members: DataFrame, leaders: DataFrame, scratch: Scratch, name: str, linked_with, decide) -> DataFrame:
    """Links (a, b) of large groups. members: grp, rep, load, parts (more than one). leaders: grp and the rep of its leader."""
    kinds = {"grp": "long", "rep": "long"}
    chosen = members.join(leaders.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())), ["grp", "rep"])
    led = scratch.save(_dealt(_own(members).unionByName(_to_all(chosen))).mapInArrow(*_led(linked_with)), f"{name}-led")
    sized = led.join(members.select("grp", "parts").distinct(), "grp").groupBy("grp", "parts").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("linked")).alias("rest")).where("rest > 0")
    share = lambda n: F.ceil(F.col("parts") * n / F.col("n")).cast("long")
    sized = sized.select("grp", share(F.col("rest")).alias("rest_parts"), share(F.col("n") - F.col("rest")).alias("linked_parts"))
    sized = scratch.save(sized, f"{name}-sized")
    rows = led.join(small(sized, sized.count()), "grp").select("grp", "rep", "load", "linked", "rest_parts", "linked_parts")
    pairs = _dealt(rows.mapInArrow(_pairs_of_parts, _CELL)).mapInArrow(decide, "a long, b long")
    return pairs.unionByName(led.where("linked AND rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")))


def _light_pairs(code: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Every two rows (the smaller first) that share a shingle which at most ``most`` rows have, once for each such shingle."""
    by = np.lexsort((row, code))
    code, row = code[by], row[by]
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, most):
        same = np.flatnonzero(code[d:] == code[:-d])
        if not len(same):
            break
        found.append(np.stack([row[same], row[same + d]]))
    return np.concatenate(found, axis=1)


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int, block: int = 1024, columns: int = 4096, light: int = 24) -> np.ndarray:
    """Links enough to connect the sets that are connected by links (two rows of numbers); with sides, by links across them.

    Intersections are exact: shingles of one set count for its size alone, those of a few sets
    (up to ``light``) are counted pair by pair, the others by products of 0/1 matrices.
    """
    sizes = np.array([len(x) for x in sets])
    links = Links(len(sets), np.ones(len(sets), np.int64))
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    some = (often[code] > 1) & (often[code] <= light)
    pairs = _light_pairs(code[some], row[some], light)
    left = np.arange(len(sets)) if side is None else np.flatnonzero(side == 0)
    right = left if side is None else np.flatnonzero(side == 1)
    if side is not None:
        pairs = pairs[:, side[pairs[0]] != side[pairs[1]]]
        swap = side[pairs[0]] == 1
        pairs = np.where(swap, pairs[::-1], pairs)
        place = np.zeros(len(sets), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        pairs = place[pairs]
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    heavy = often > light
    number = np.cumsum(heavy) - 1
    row, code = row[heavy[code]], number[code[heavy[code]]]
    n = int(heavy.sum())
    first = np.searchsorted(row, np.arange(len(sets) + 1))

    def dense(rows: np.ndarray, lo: int) -> np.ndarray:
        out = np.zeros((len(rows), min(columns, n - lo)), np.float32)
        at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
        of = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
        inside = (code[at] >= lo) & (code[at] < lo + out.shape[1])
        out[of[inside], code[at][inside] - lo] = 1
        return out

    for i in range(0, len(left), block):
        p = left[i : i + block]
        own = pairs[:, slice(*np.searchsorted(pairs[0], (i, i + len(p))))]
        for j in range(i if side is None else 0, len(right), block):
            q = right[j : j + block]
            inside = side is None and i == j
            a, b = own[:, (own[1] >= j) & (own[1] < j + len(q))]
            both = np.bincount((a - i) * len(q) + b - j, minlength=len(p) * len(q)).reshape(len(p), len(q)).astype(float)
            if inside:
                both += both.T
            for lo in range(0, n, columns):
                x = dense(p, lo)
                both += x @ (x if inside else dense(q, lo)).T
            mask = 100 * both >= percent * (sizes[p][:, None] + sizes[q] - both)
            if inside:
                np.fill_diagonal(mask, False)
                q = p
            if mask.any():
                links.some_of(p, q, mask)
    edges = np.concatenate([np.zeros((2, 0), np.int64), *links.edges], axis=1)
    return np.unique(edges[:, edges[0] != edges[1]], axis=1)


def _decide(s: Settings):
    """Links within each part, or across two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            if part.num_rows < 2:
                continue
            rep, side, k = part.column(3).to_numpy(), part.column(2).to_numpy(), part.column(1)[0].as_py()
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(4)]
            e = linked(sets, None if k >> 31 == k & 0x7FFFFFFF else side, s.percent)
            yield _pairs([rep[e[0]]], [rep[e[1]]])

    return run


def _decide_sketches(s: Settings):
    """The same by sketches, which are compared block by block."""
    low = s.percent / 100 - s.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            rep, side, k = part.column(3).to_numpy(), part.column(2).to_numpy(), part.column(1)[0].as_py()
            bits = _sketches(part.column(4))
            inside = k >> 31 == k & 0x7FFFFFFF
            left = np.arange(len(rep)) if inside else np.flatnonzero(side == 0)
            right = left if inside else np.flatnonzero(side == 1)
            links = Links(len(rep), np.ones(len(rep), np.int64))
            for i in range(0, len(left), 512):
                p = left[i : i + 512]
                for j in range(i if inside else 0, len(right), 512):
                    q = p if inside and i == j else right[j : j + 512]
                    ones = sum(np.bitwise_count(bits[p][:, None, w] ^ bits[q][None, :, w]).astype(np.int64) for w in range(_BITS // 64))
                    mask = similarity(ones, s.samples) >= low
                    if q is p:
                        np.fill_diagonal(mask, False)
                    if mask.any():
                        links.some_of(p, q, mask)
            e = np.concatenate([np.zeros((2, 0), np.int64), *links.edges], axis=1)
            e = np.unique(e[:, e[0] != e[1]], axis=1)
            yield _pairs([rep[e[0]]], [rep[e[1]]])

    return run


def _n_parts(s: Settings, n: Column) -> Column:
    rows = F.least(F.lit(s.most_rows), F.greatest(F.lit(s.part_rows), F.ceil(n / 24)))
    return F.ceil(n / rows).cast("long")


def _family_pairs(reps: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """Links by sketches (a, b) that join the members of each bucket into families. reps: rep, samples."""
    hot = reps.mapInArrow(*_bands(s, sketched=False)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.bucket_rows)
    hot = scratch.save(hot, "hot-buckets")
    n_hot = hot.count()
    banded = reps.mapInArrow(*_bands(s))
    cold = banded.join(small(hot.select("key"), n_hot), "key", "left_anti") if n_hot else banded
    near = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_family_links(s), "a long, b long")
    if n_hot:
        members = banded.join(small(hot, n_hot), "key").select(F.col("key").alias("grp"), "rep", F.col("sketch").alias("load"), _n_parts(s, F.col("n")).alias("parts"))
        members = scratch.save(members, "hot-members")
        leaders = members.groupBy("grp").agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"))
        near = near.unionByName(_meet(members, leaders, scratch, "hot", _near_sketches(s), _decide_sketches(s)))
    return near


def _shared_ids(usable: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links between the representatives of a doc_id's different texts; None if every doc_id has one text."""
    many = usable.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("set1", "set2") for f in (F.min, F.max))).where("set1_min < set1_max OR set2_min < set2_max").select("doc_id")
    many = scratch.save(many, "many")
    n = many.count()
    if not n:
        return None
    of = usable.join(small(many, n), "doc_id").select("doc_id", "set1", "set2").join(classes, ["set1", "set2"])
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links lead to, the row's own included; kept says
    whether that is the row's own. A text without words, or null, has no shingles and links
    with nothing. Rows with the same doc_id are one document: a link of either text counts for
    both, and identical rows come out as often as they go in. A row with a null doc_id links
    with nothing, has a null component_id and is kept. An empty table gives an empty table.
    """
    s = settings
    scratch = Scratch(documents.sparkSession, "neardup")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(*_sign(s)), "signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    reps = usable.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "samples")).alias("x")).select(F.col("x.doc_id").alias("rep"), "x.samples")
    reps = scratch.save(reps, "reps")
    families = scratch.save(components(_family_pairs(reps, scratch, s), scratch, "near").withColumnRenamed("component", "family"), "families")
    n_members = families.count()
    texts = docs.join(small(families.select(F.col("node").alias("doc_id")), n_members), "doc_id", "left_semi")
    sets = scratch.save(texts.mapInArrow(*_sets(s)).dropDuplicates(["rep", "shingles"]), "sets")
    sized = sets.select("rep", F.octet_length("shingles").alias("bytes")).join(small(families, n_members), sets["rep"] == families["node"])
    sized = sized.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    parts = F.greatest(_n_parts(s, F.col("n")), F.ceil(F.col("bytes") / (8 * s.part_shingles)).cast("long"))
    placed = scratch.save(families.join(sized.select("family", "n", parts.alias("parts")), "family"), "placed")
    members = sets.join(small(placed, n_members), sets["rep"] == placed["node"]).select(F.col("family").alias("grp"), "rep", F.col("shingles").alias("load"), "n", "parts")
    whole = members.where("parts = 1").select("grp", F.lit(0).cast("long").alias("part"), F.lit(0).cast("byte").alias("side"), "rep", "load")
    links = _dealt(whole).mapInArrow(_decide(s), "a long, b long")
    if not placed.where("parts > 1").isEmpty():
        members = scratch.save(members.where("parts > 1"), "members")
        sampled = reps.join(small(placed.where("parts > 1"), n_members), reps["rep"] == placed["node"]).select(F.col("family").alias("grp"), "rep", F.col("samples").alias("load"), "n", "parts")
        few = sampled.where((F.pmod(F.xxhash64(F.lit(41), "rep"), F.lit(1 << 20)) < F.lit(s.samples_of << 20) / F.col("n")))
        scores = _dealt(_own(sampled).unionByName(_to_all(few))).mapInArrow(*_likeness(s))
        leaders = scores.groupBy("grp").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("rep"))
        links = links.unionByName(_meet(members.drop("n"), leaders, scratch, "large", _like_sets(s), _decide(s)))
    shared = _shared_ids(usable, classes, scratch)
    links = scratch.save(links if shared is None else links.unionByName(shared), "links")
    named = components(links, scratch, "linked")
    scratch.drop("reps", "hot-buckets", "hot-members", "hot-led", "hot-sized", "sets", "families", "placed", "members", "large-led", "large-sized", "many", "links")
    classes = classes.join(named, classes["rep"] == named["node"], "left").select("set1", "set2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set1", "set2").join(classes, ["set1", "set2"], "left")
    # A text without words takes no part.
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
