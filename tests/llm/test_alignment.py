"""Two tokenizers aligned, against both libraries and plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import alignment
from marlstone.llm.alignment import Settings

from . import cases

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    odd = ["<|endoftext|> is plain", "a▁b", "▁", " two  blanks ", "\n\n\tx\r\n", "<s>x</s> <unk> <0x41>", "é́ ｆｕｌｌ ﬁ ½ ٣", "​ 　z", "😀😀👩‍👩‍👧", "x" * 500, "zxq" * 400, "\x00y\x7f", "naïve café", " ", "\n", "ab", "ab", "ab ab"]
    return cases.odd_texts() + odd


def expected(rows):
    """All columns of (doc_id, text) rows, with both libraries and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    odd = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x)]
    byte = {chr(x): x for x in range(256) if x not in odd} | {chr(256 + i): x for i, x in enumerate(odd)}
    found = []
    for _, t in rows:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        parts_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
            found.append([])
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        shared, groups = sorted(set(ends_a) & set(ends_b)), []
        for low, high in zip([0, *shared], shared, strict=False):
            groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= high], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= high]))
        found.append(groups)
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in found]
    counts = Counter(pair for of in links for pair in of)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), groups, of in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        numbers = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(of.values()), sum(n for p, n in of.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in of.items())
        out.append((i, *numbers, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [Settings(), Settings(looked_up=200, held=500), Settings(looked_up=0)])
def test_against_both_libraries(spark, settings):
    """Whether counts are looked up, partly or not at all; null, empty and long texts, repeated rows, rows without an id, clashing names."""
    rows = [*enumerate(t if t is None or len(t) < 20000 else t[:20000] for t in texts()), (None, "ab"), (None, "other words"), (5, "one"), (5, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in (*cases.CLASHING, "row", "pair", "pairs", "n", "times", "n_a")})
    got = alignment.alignment(df, A, B, settings)
    assert got.columns == [*COLUMNS, "n_overlaps"]
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == expected(rows)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = alignment.alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), A, B)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == expected(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(none, A, B).count() == 0
    assert [tuple(r) for r in alignment.alignment(spark.createDataFrame([(1, None)], none.schema), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", 0)]


def test_intervals_and_large_groups(monkeypatch):
    """Each interval is an overlap of its two owners; a group's product is the same by distinct ids."""
    r = np.random.default_rng(3)
    for n in (1, 2, 50):
        a_ends, b_ends = (np.unique(np.append(r.integers(1, 4 * n, 3 * n // 2), 4 * n)) for _ in range(2))
        found = alignment.align(a_ends, b_ends)
        start = np.append(0, found.intervals[:-1])
        for k, (low, high) in enumerate(zip(start, found.intervals, strict=True)):
            assert a_ends[found.a_owner[k]] >= high and (found.a_owner[k] == 0 or a_ends[found.a_owner[k] - 1] <= low)
        assert found.groups == len(set(a_ends) & set(b_ends))
        a_ids, b_ids = r.integers(0, 5, len(a_ends)), r.integers(0, 5, len(b_ends))
        doc = np.zeros(found.groups, np.int64)
        plain = alignment.links(a_ids, b_ids, found, doc, 10)
        monkeypatch.setattr(alignment, "_LARGE_GROUP", 1)
        assert all(np.array_equal(x, y) for x, y in zip(plain, alignment.links(a_ids, b_ids, found, doc, 10), strict=True))
        monkeypatch.undo()
        want = Counter((int(x), int(y)) for g in range(found.groups) for x in a_ids[found.a_group == g] for y in b_ids[found.b_group == g])
        assert Counter({(int(p) // 10, int(p) % 10): int(t) for p, t in zip(plain[1], plain[2], strict=True)}) == want


def test_a_wrong_cached_word_is_encoded_again():
    """Ids that don't give a text's bytes, as after a clash of hashes, are not used."""
    s = alignment.Sides(A, B)
    texts = [b"one two three", b"four"]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    right = s.encode(buf, offsets)
    s.a_cache.pool[:] = s.a_cache.pool[::-1].copy()
    s.b_cache.pool[:] = s.b_cache.pool[::-1].copy()
    assert all(np.array_equal(x, y) for x, y in zip(right, s.encode(buf, offsets), strict=True))
