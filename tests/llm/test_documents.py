"""The operators over documents, on odd cases, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontam, licenses, neardup, pieces, quality, sharding, substrings, tokenfile

from . import cases

P = pytest.importorskip("public_tokenizers")
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


TEXTS = dict(enumerate(cases.odd_texts()))


def test_near_duplicates(spark, docs):
    twice = docs.unionByName(docs.where("doc_id IN (0, 3)")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    rows = neardup.near_duplicates(twice).collect()
    want = cases.near_duplicates(TEXTS, 3, 85)
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(cases.shingles(TEXTS[r["doc_id"]], 3)), want[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_in_a_chain(spark):
    """Copies that drift: neighbours link, ends do not; one part at a time is decided, so parts must meet."""
    base = cases.words(150, 9)
    texts = {}
    for i in range(40):
        texts[100 - i] = " ".join(base)
        base = [*base[:i], f"w{i}", *base[i + 1 :]]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for settings in (neardup.Settings(), neardup.Settings(part_rows=7), neardup.Settings(part_rows=7, most_rows=3, bucket_rows=4, samples_of=5)):
        assert {i: r["component_id"] for i, r in by_id(neardup.near_duplicates(df, settings)).items()} == cases.near_duplicates(texts, 3, 85)


def test_near_duplicates_in_large_groups(spark):
    """Copies of a few bases, all in hot buckets and large families: leaders first, the rest in parts."""
    import random

    r = random.Random(8)
    texts = {}
    for i in range(240):
        w = cases.words(90, 300 + i % 3)
        for _ in range(r.choice((0, 1, 2, 3, 9))):
            w[r.randrange(90)] = f"x{r.randrange(10**6)}"
        texts[1000 - i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = cases.near_duplicates(texts, 3, 85)
    assert len(set(want.values())) > 20
    for settings in (neardup.Settings(part_rows=16, most_rows=16, bucket_rows=20, samples_of=8), neardup.Settings(part_rows=16, most_rows=16, bucket_rows=20, samples_of=0, part_shingles=500)):
        assert {i: x["component_id"] for i, x in by_id(neardup.near_duplicates(df, settings)).items()} == want


def test_one_id_with_several_texts(spark):
    """Is one document: what its texts link with is connected through it."""
    a, b = " ".join(cases.words(50, 1)), " ".join(cases.words(50, 2))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, ""), (7, b + " end")], "doc_id long, text string")
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 7, True), (9, 3, False)]


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_odd_sketch():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, (400, 96), np.uint64).astype(np.uint32)
    for share in (0.95, 0.85, 0.7):
        b = np.where(r.random(a.shape) < share, a, a + np.uint32(1))
        ones = np.bitwise_count(neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).sum(1)
        assert abs(neardup.similarity(ones, 96).mean() - share) < 0.02


def test_substrings(spark, docs):
    want = cases.kept_words(TEXTS)
    for settings in (substrings.Settings(), substrings.Settings(shard_words=50)):
        got = by_id(substrings.remove_repeats(docs, settings, carry=("source",)))
        for i, (w, gone) in want.items():
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
            assert got[i]["kept_text"] == (kept if any(gone) else TEXTS[i] or "")


def test_substrings_around_a_frequent_line(spark):
    """A line that stands in every text among other words, and longer runs that recur around it: keys grow until they are rare."""
    import random

    r, line = random.Random(6), cases.words(9, 700)
    pool = [cases.words(8, 710 + i) for i in range(3)]
    texts = {}
    for i in range(80):
        w = []
        for k in range(3):
            w += cases.words(12, 1000 + 10 * i + k) + (r.choice(pool) if r.random() < 0.7 else []) + line + (r.choice(pool) if r.random() < 0.7 else [])
        texts[200 - i] = ("\n" if i % 2 else "  ").join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = cases.kept_words(texts)
    assert sum(map(sum, (g for _, g in want.values()))) > 500
    for settings in (substrings.Settings(key_rows=20), substrings.Settings(key_rows=0), substrings.Settings(key_rows=3, shard_words=100)):
        got = by_id(substrings.remove_repeats(df, settings))
        for i, (w, gone) in want.items():
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_words_whose_hashes_agree_are_told_apart(monkeypatch):
    buf = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    begin, end = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    for hashes in ([1, 2, 1, 3, 2], [1, 1, 1, 1, 1], [7, 7, 7, 9, 7]):
        monkeypatch.setattr(substrings, "hash_spans", lambda *_, h=hashes: np.array(h, np.uint64))
        codes = substrings.word_codes(buf, begin, end).tolist()
        assert codes[0] == codes[2] and codes[1] == codes[4] and len(set(codes)) == 3


def test_substrings_repeated_and_null_ids(spark):
    text = " ".join(cases.words(30, 8))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (0, " ".join(cases.words(25, 7)))], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(df).collect()) == [(False, 0, 0), (False, 1, 0), (False, 1, 0), (True, 0, 30)]
    assert substrings.remove_repeats(df.where("false")).count() == 0


def test_fm_index_streams_unknown_text():
    from marlstone.llm.fmindex import FMIndex

    r = np.random.default_rng(3)
    words = r.integers(0, 4, 600)
    first = np.array([0, 200, 450, 600])
    index = FMIndex(words, first, 17)
    probe = np.concatenate([words[30:90], r.integers(0, 6, 200), words[460:520]])
    stat, group = index.search(probe, np.array([0, 60, 260, 320]))
    texts = ["".join(map(str, words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
    for a, b in ((0, 60), (60, 260), (260, 320)):
        for i in range(a, b):
            longest = 0
            while longest < 17 and i + longest < b and any("".join(map(str, probe[i : i + longest + 1])) in t for t in texts):
                longest += 1
            assert stat[i] == longest and (group[i] >= 0) == (longest == 17)


def test_licenses(spark, docs):
    got = by_id(licenses.scan(docs))
    for i, text in TEXTS.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", cases.lower(text or ""))
        base = sorted((j, label) for p, label in licenses.BASE.items() for q in [p.split()] for j in range(len(w)) if w[j : j + len(q)] == q)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(base), ",".join(sorted({b[1] for b in base})))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None)) and 0 <= r["score"] <= 1
    assert got[11]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and got[0]["labels"] == "" and got[2]["score"] == 0
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and its associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"), ("Licensed under the Apache License, Version 1.1", ""), ("under the MIT roof", ""), ("licensed under the gnu general public license version 2", "gpl,gpl-2.0"), ("license " * 500, ""),
    ],
)
def test_license_templates(spark, text, labels):
    df = spark.createDataFrame([(1, "x " * 40 + text + " y" * 9)], "doc_id long, text string")
    assert licenses.scan(df).first()["labels"] == labels


def brute_labels(text: str) -> set:
    """Labels of every template for which some start has enough words near, two of its rarest words there, and all key phrases."""
    s, w = licenses.Settings(), re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", cases.lower(text))
    templates = [(t[0], t[1].split(), [k.split() for k in t[2]]) for t in licenses.TEMPLATES]
    df = {}
    for _, words, _ in templates:
        for x in set(words):
            df[x] = df.get(x, 0) + 1
    found = set()
    for label, words, keys in templates:
        hashed = {x: int(licenses.words_of(x.encode())[0]) for x in words}
        rare = set(sorted(set(words), key=lambda x: (-np.log((1 + len(templates)) / df[x]), hashed[x]))[: s.rare])
        posts = {(q - p, p) for q, x in enumerate(w) if x in rare for p, y in enumerate(words) if y == x}
        for start in {a for a, _ in posts}:
            # All posts that hang together by gaps within the slack.
            run, grown = {start}, True
            while grown:
                new = {a for a, _ in posts if any(abs(a - b) <= s.slack for b in run)}
                grown, run = new != run, new
            if len({p for a, p in posts if a in run}) < min(2, len(set(words))):
                continue
            near = sum(any(0 <= start + j + e < len(w) and w[start + j + e] == x for e in range(-s.slack, s.slack + 1)) for j, x in enumerate(words))
            part = w[max(0, start - s.slack) : max(0, start + len(words) + s.slack)]
            if near / len(words) >= s.coverage and all(any(part[i : i + len(k)] == k for i in range(len(part))) for k in keys):
                found.add(label)
    return found


def test_license_labels_against_brute_force(spark):
    import random

    r = random.Random(3)
    texts = []
    for k in range(60):
        _, notice, _ = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = notice.split()
        for _ in range(r.randint(0, 3)):  # words put in, left out, or replaced
            i = r.randrange(len(words))
            words[i : i + r.randint(0, 1)] = r.choice(([], ["the"], ["license"], ["zz", "yy"]))
        texts.append(" ".join(cases.words(r.randint(0, 9), k) + words * r.randint(1, 2) + cases.words(r.randint(0, 9), k + 99)))
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        assert set(filter(None, got[i]["labels"].split(","))) - set(filter(None, got[i]["base_labels"].split(","))) == brute_labels(t) - set(filter(None, got[i]["base_labels"].split(","))), t


def test_a_notice_repeated_very_often():
    import time

    index, words = licenses.Index(licenses.Settings()), licenses.words_of(b"apache license version 2 0 " * 20000)
    began = time.time()
    assert index.match(words, index.lookup(words)) == {}
    assert time.time() - began < 5


def test_decontamination(spark, docs):
    item = cases.words(40, 21)
    swapped = [w if i % 9 else "zz" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny but exact passage"), (5, "unseen " * 5)], "item_id long, text string")
    extra = spark.createDataFrame([(101, " ".join(cases.words(60, 30) + swapped + cases.words(9, 31))), (102, "Here: TINY, but exact passage!"), (103, " ".join(item[:9])), (104, " ".join(item).upper())], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    assert {r["doc_id"]: r["item_ids"] for r in decontam.contaminated(rows, bench).collect()} == {101: [1], 102: [4], 104: [1]}
    assert decontam.contaminated(docs.where("false"), bench).count() == 0 and decontam.contaminated(docs, bench.where("false")).count() == 0


def brute_overlaps(doc: list[str], item: list[str], s) -> tuple[int, int, int] | None:
    """(equal words, words, seed hits) of the best overlap; every seed hit is extended, word by word."""
    masks = [m for m in s.masks if len(m) <= len(item)] if len(item) >= min(map(len, s.masks)) else ["1" * len(item)]
    hits = [(a, p) for m in masks for a in range(len(doc) - len(m) + 1) for p in range(len(item) - len(m) + 1) if all(c == "0" or doc[a + j] == item[p + j] for j, c in enumerate(m))]

    def reach(a, p, step):
        score = best = length = n = 0
        while 0 <= a < len(doc) and 0 <= p < len(item):
            score += 1 if doc[a] == item[p] else -3
            n += 1
            if score > best:
                best, length = score, n
            if max(best, 1 if doc[a] == item[p] and n == 1 else best) - score > s.drop:
                break
            a, p = a + step, p + step
        return length

    best = None
    for a, p in hits:
        back, ahead = reach(a - 1, p - 1, -1), reach(a, p, 1)
        same = sum(doc[a + k] == item[p + k] for k in range(-back, ahead))
        need = min(s.least_words, max(1, int(np.ceil(s.short_share * len(item)))))
        if back + ahead >= need and same >= s.agree * (back + ahead):
            best = max(best or (0, 0), (same, back + ahead))
    return best and (*best, len(hits))


def test_decontamination_against_brute_force(spark):
    """Items with words replaced, of all lengths, in documents with null and repeated ids; a broadcast and a joined benchmark."""
    import random

    r, s = random.Random(12), decontam.Settings()
    items = [(i, " ".join(cases.words(r.choice((4, 7, 9, 14, 30, 60)), 800 + i))) for i in range(25)] + [(None, " ".join(cases.words(20, 899))), (3, " ".join(cases.words(18, 898))), (99, None), (98, "")]
    rows = [(1, None), (2, ""), (None, " ".join(cases.words(20, 899)))]
    for k in range(90):
        part = r.choice(items[:27])[1].split()
        for _ in range(r.randint(0, 5)):
            part[r.randrange(len(part))] = "other"
        cut = r.randint(0, len(part) // 2)
        rows.append((k % 50, ", ".join(cases.words(r.randint(0, 30), 1000 + k) + part[cut:] + cases.words(r.randint(0, 9), 2000 + k))))
    rows.append(rows[-1])
    want = []
    for d, text in rows:
        for i, item in items:
            w, x = (re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", cases.lower(t or "")) for t in (text, item))
            found = brute_overlaps(w, x, s) if w and x else None
            if found:
                want.append((d, i, *found))
    assert len(want) > 30
    df, bench = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((rows, "doc_id"), (items, "item_id")))
    for settings in (s, decontam.Settings(broadcast_bytes=0), decontam.Settings(broadcast_bytes=900)):
        got = decontam.overlaps(df, bench, settings).collect()
        assert sorted(((x["doc_id"], x["item_id"], x["n_equal"], x["n_words"], x["n_hits"]) for x in got), key=repr) == sorted(want, key=repr)
    ids = {x["doc_id"]: x["item_ids"] for x in decontam.contaminated(df, bench).collect()}
    assert ids == {d: sorted({i for e, i, *_ in want if e == d and i is not None}) for d in {w[0] for w in want}}


def test_rows_without_an_id_and_repeated_ones(spark):
    """Each row is judged by its own text, and comes out as often as it goes in."""
    text, other = "All rights reserved. " + " ".join(cases.words(30, 61)), " ".join(cases.words(30, 62))
    rows = [(None, text), (None, other), (4, text), (4, text), (4, other), (None, None)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, source string")
    ids = sorted((repr(i) for i, _ in rows))
    found = licenses.scan(df).collect()
    assert sorted(repr(r["doc_id"]) for r in found) == ids and sorted((repr(r["doc_id"]), r["n_base"]) for r in found) == sorted((repr(i), int(t == text)) for i, t in rows)
    dealt = sharding.shard_documents(df).collect()
    assert sorted((repr(r["doc_id"]), r["text_crc32"]) for r in dealt) == sorted((repr(i), cases.crc(t)) for i, t in rows) and all(r["slot"] == 0 for r in dealt)
    assert len({r["shard"] for r in dealt}) == len(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    scored = quality.classify(df, labels).collect()
    assert sorted(repr(r["doc_id"]) for r in scored) == ids and not any(r["held_out"] for r in scored if r["doc_id"] is None) and len({r["score"] for r in scored}) <= 3
    path = P.path("piece_bpe_32k.model")
    encoded = pieces.encode(df, path, pieces.Settings(), ("ids", "lossless", "decoded_crc32")).collect()
    assert sorted((repr(r["doc_id"]), r["decoded_crc32"]) for r in encoded) == sorted((repr(i), cases.crc(t)) for i, t in rows) and all(r["lossless"] for r in encoded)
    assert len({tuple(r["ids"]) for r in encoded if r["doc_id"] == 4}) == 2


def test_masks_take_one_substitution():
    for size in (13, 14, 20):
        for bad in range(size):
            assert any(all(not (m == "1" and o + j == bad) for j, m in enumerate(mask)) for mask in decontam.MASKS for o in range(size - len(mask) + 1))


def test_quality(spark, docs):
    good = [" ".join(cases.words(80, 100 + i)) for i in range(160)]
    bad = [" ".join(w + "***" for w in cases.words(80, 500 + i)) for i in range(160)]
    df = cases.frame(spark, good + bad + [None, "", "x" * 300000])
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(320)] + [(5, 0, 0), (None, 1, 0), (7, None, 0), (400, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 323 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 320]
    assert sum(r["predicted"] == (r["doc_id"] < 160) for r in held) >= 0.95 * len(held)
    assert {r["predicted"] for r in quality.classify(docs, labels.where("false")).collect()} == {1}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_quality_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs.unionByName(docs.where("doc_id < 3"))).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        t = TEXTS[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((t or "").encode()) + 1, cases.crc(t), "rows", None)
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(docs.where("false")).count() == 0


def test_sharding_mixture(spark):
    """Against ranking in plain Python; every shard has each source in proportion."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = sharding.interleave(df, 16).withColumn("h", F.xxhash64(F.lit(17), F.col("doc_id"))).collect()
    sources = {}
    for r in sorted(got, key=lambda r: (r["h"] % (1 << 64) >> 1, r["doc_id"])):
        sources.setdefault(r["source"], []).append(r)
    order = sorted(((i + 0.5) / len(v), f"={s}", r["doc_id"]) for s, v in sources.items() for i, r in enumerate(v))
    place = {d: i for i, (_, _, d) in enumerate(order)}
    first = [-(-s * 9000 // 16) for s in range(17)]
    assert all(place[r["doc_id"]] == first[r["shard"]] + r["slot"] for r in got)
    for s, v in sources.items():
        counts = [sum(r["shard"] == k for r in v) for k in range(16)]
        assert all(abs(c - len(v) / 16) <= 1 + len(v) / 9000 * len(sources) for c in counts), s


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, start = by_id(tokenfile.tokenize_documents(docs, P.path("byte_bpe_50k.json"))), 0
    for i in sorted(TEXTS):
        ids = [*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["last_id"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), 2)
        start += len(ids)
    assert tokenfile.tokenize_documents(docs.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_token_files_without_ids(spark):
    """A null doc_id stays null and comes first; -1 is an id like any other; rows of one id stay apart."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(None, "no id <|endoftext|> here"), (-1, "minus one"), (-5, None), (None, ""), (7, "twice"), (7, "another")]
    got = tokenfile.tokenize_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted((repr(i), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -5, -1, 7, 7]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(6)]


def test_token_file_random_access():
    ids = np.random.default_rng(0).zipf(1.2, 9000) % 70_000_000
    first = np.array([0, 0, 10, 8000, 9000])
    file = tokenfile.TokenFile(tokenfile.encode_file(np.array([5, 6, 7, 8]), first, ids))
    assert [file.token(i) for i in range(0, 9000, 13)] == ids[::13].tolist() and all((file.document(i) == ids[a:b]).all() for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)))
    assert tokenfile.TokenFile(tokenfile.encode_file(np.zeros(0, int), np.zeros(1, int), np.zeros(0, int))).n_tokens == 0
    with pytest.raises(IndexError):
        file.token(9000)


WHITE = ["  a  b \n c", "a  b　 c", "don't  I'll\tx \n y", "x\u0085 y", "trail  ", "a\r\n b", "\x1c a\x1d b", "😀 😀  hi", "<|endoftext|> x", "x <|endoftext|> y", "x  <|endoftext|>  y", "a<|endoftext|>b\n<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext", "\n\n  x", "￾ b", "a\x7f b"]


def test_chunks_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marlstone.llm.textkernel import slices

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = tokenfile.byte_bpe_cache(P.path("byte_bpe_50k.json"))
    for _, _, buf, offsets in slices(pa.RecordBatch.from_pydict({"text": WHITE}), "text"):
        ids, n = cache.ids(buf, offsets)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(WHITE):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = by_id(pieces.encode(docs, path, pieces.Settings(dropout=0.0), ("ids", "decoded", "lossless")))
    varied = by_id(pieces.encode(docs, path, pieces.Settings(), ("ids", "n_tokens", "ids_crc32", "decoded_crc32", "lossless")))
    again = by_id(pieces.encode(docs.repartition(5), path, pieces.Settings(), ("ids",)))
    for i, t in TEXTS.items():
        if "▁" not in (t or ""):
            assert plain[i]["ids"] == sp.encode(t or "")
        assert plain[i]["decoded"] == (t or "") and plain[i]["lossless"] and varied[i]["lossless"]
        assert varied[i]["ids"] == again[i]["ids"] and varied[i]["n_tokens"] == len(varied[i]["ids"]) and varied[i]["decoded_crc32"] == cases.crc(t)
        assert varied[i]["ids_crc32"] == zlib.crc32(np.array(varied[i]["ids"], "<u4").tobytes())
    assert varied[10]["ids"] != plain[10]["ids"] and len(varied[10]["ids"]) > len(plain[10]["ids"])
    back = by_id(pieces.decode(pieces.encode(docs, path), path))
    assert all(back[i]["text"] == (t or "") for i, t in TEXTS.items())
    assert pieces.encode(docs.where("false"), path).count() == 0


def test_merging_together_is_merging_one_by_one():
    model = pieces.Model(P.path("piece_bpe_32k.model"))
    words = [np.array([ord(c) for c in " " + w], np.uint32) for w in cases.words(200, 77) + ["internationalisation", "öffentlichkeit", "aaaaaaaaaaaaaa"]]
    keys = np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    together, one = (pieces.PieceCache(model, pieces.Settings(dropout=0.3, longest=n)).segment(words, keys) for n in (48, 0))
    assert (together[0] == one[0]).all() and (together[1] == one[1]).all()


def test_every_occurrence_draws_for_itself(spark):
    """A frequent word has as many segmentations as its candidates give, and looked-up runs are those of each key."""
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "international " * 3000)], "doc_id long, text string")
    ids = df.transform(lambda d: pieces.encode(d, path)).first()["ids"]
    model = pieces.Model(path)
    found, word = set(), []
    for i in ids:
        if word and model.parts[model.part_at[i]] == 32:
            found.add(tuple(word))
            word = []
        word.append(i)
    assert len(found) > 20
    words = [np.array([ord(c) for c in " " + w], np.uint32) for w in cases.words(60, 78) + ["öffentlichkeit", "a", "☃☃ß", "international", "x" * 70]] * 40
    keys = pieces.keyed(np.arange(len(words)), 5)
    lengths = np.array([len(w) for w in words])
    starts, points = np.cumsum(lengths) - lengths, np.concatenate(words)
    run = pieces.hash_spans(points, starts, starts + lengths)
    for looked_up in (8, 48):
        cache = pieces.PieceCache(model, pieces.Settings(dropout=0.3, looked_up=looked_up))
        sizes, want = cache.segment(words, keys)
        for _ in range(2):  # while runs are made known, and when they are known
            size, at, pool = cache.runs(points, starts, lengths, run, keys)
            assert (size == sizes).all() and (pool[pieces.ragged(at, size)] == want).all()


def one_by_one(text: str, doc_id: int, sp, rate: float, seed: int) -> list[int]:
    """Merge-dropout in plain Python numbers: the best candidate that its key doesn't skip, until there is none."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    keyed = lambda x, k: mix(mix(x + k & mask) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D & mask)
    score = {sp.id_to_piece(i): (int(-sp.get_score(i)), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    whole, out, number, at = " " + text, [], 0, 0
    while at < len(whole):
        end = at + 1
        while end < len(whole) and not (whole[end] == " " and whole[end - 1] != " " or "\n" in whole[end - 1 : end + 1]):
            end += 1
        word = whole[at:end]
        run = mix(sum((ord(c) + 1) * keyed(i, 0x5EED) for i, c in enumerate(word)) + len(word) * 0xA0761D6478BD642F & mask)
        key = mix(run + keyed(keyed(doc_id, seed + 2) + number & mask, seed) & mask)
        cuts = list(range(len(word) + 1))
        while True:
            best = None
            for i in range(len(cuts) - 2):
                a, b, c = cuts[i : i + 3]
                piece = word[a:c].replace(" ", "▁")
                code = mix(a * 0x9FB21C651E98DF25 + b * 0xD6E8FEB86659FD93 + c & mask)
                if piece in score and mix(key + code & mask) >> 11 >= int(rate * (1 << 53)):
                    best = min(best or (9e9,), (score[piece][0], i))
            if best is None:
                break
            del cuts[best[1] + 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = word[a:b].replace(" ", "▁")
            out += [score[piece][1]] if piece in score else [sp.piece_to_id(f"<0x{x:02X}>") for x in word[a:b].encode()]
        number, at = number + 1, end
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_dropout_against_plain_python(spark, rate):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["The international organisation of straightforward documentation, again and again and again.", "Öffentlichkeit  und\nVerwaltung ☃ 日本語", " ".join(cases.words(60, 5)), "unbelievablycomplicatedwordsthatgoonandonwithoutanyblankinthemuntilthelineends x", "a", ""]
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    got = by_id(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pieces.Settings(dropout=rate), ("ids", "lossless")))
    for i, t in rows:
        assert got[i]["ids"] == (one_by_one(t, i, sp, rate, 29) if t else []) and got[i]["lossless"]


@pytest.mark.parametrize("light", [1, 3, 24])
@pytest.mark.parametrize("sided", [False, True])
def test_linked_sets(light, sided):
    """Blocks of any size and both ways of counting give the components of all pairs."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, (3, 60), np.uint64)
    sets = []
    for i in range(90):
        s = base[i % 3].copy()
        s[r.integers(0, 60, r.integers(0, 9))] = r.integers(0, 40, 1, np.uint64)
        sets.append(np.unique(s))
    side = r.integers(0, 2, 90) if sided else None

    def link(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return (side is None or side[a] != side[b]) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    want = cases.component_ids(list(range(90)), link)
    e = neardup.linked(sets, side, 85, block=16, columns=32, light=light)
    assert cases.component_ids(list(range(90)), lambda a, b: bool(((e[0] == a) & (e[1] == b) | (e[0] == b) & (e[1] == a)).any())) == want


def test_a_class_of_long_texts_only(spark):
    """Labelled texts beyond the bound of a sample are learnt from in blocks, never left out."""
    long = [" ".join(cases.words(7000, 100 + i)) for i in range(60)]
    short = ["$$$ ### buy now *** " * (3 + i % 5) for i in range(60)]
    assert min(map(len, long)) > quality.Settings().longest_sample
    docs = spark.createDataFrame(list(enumerate(long + short)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    got = by_id(quality.classify(docs, labels))
    assert sum(got[i]["predicted"] == int(i < 60) for i in range(120)) >= 114


def test_words_of_a_regular_pattern_are_told_apart(spark):
    """The two words that a polynomial modulo 2^64 can't tell apart: a sequence of two letters and the one with both exchanged."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    pairs = [("".join(a[b] for b in bits), "".join(a[1 - b] for b in bits)) for a in ("ab", "xy", "01")]
    texts = [w for p in pairs for w in p]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["kept"] for r in neardup.near_duplicates(df).collect())
    cache = tokenfile.byte_bpe_cache(P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts:
        ids, _ = cache.ids(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert all(r["lossless"] for r in pieces.encode(df, P.path("piece_bpe_32k.model"), pieces.Settings(dropout=0.0), ("lossless",)).collect())


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity from 0.85 to 0.9, and as many just below it: all of the first are linked, none of the others."""
    r, rows, want = np.random.default_rng(17), [], {}
    for p in range(900):
        n, replaced = 300, int(r.integers(6, 12))
        a = [f"w{p}x{k}" for k in range(n)]
        b = list(a)
        for k in range(replaced):  # far apart, so each takes three shingles from either side
            b[5 + k * 24] = f"v{p}x{k}"
        same, every = n - 2 - 3 * replaced, n - 2 + 3 * replaced
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
        want[2 * p + 1] = 2 * p if 100 * same >= 85 * every else 2 * p + 1
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    linked = [i for i, c in want.items() if c != i]
    assert 250 < len(linked) < 650 and {i: got[i]["component_id"] for i in want} == want
