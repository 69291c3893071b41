"""The audit of sources: tries, merging, and the whole against SQL and plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence, queries
from marlstone.llm.divergence import Settings, Trie

from ..compare import difference
from . import cases

FOLDER = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def test_sql(spark):
    assert difference(spark, FOLDER, queries.op12_divergence, queries.OP12_SQL) == ""


def expected(rows, least, top):
    """The audit of (lang, source, text) rows by plain Python."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(cases.lower(text or ""))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]  # noqa: E731, B023
        p = {s: share(c) for s, c in own.items()}
        q = share([sum(x) for x in zip(*own.values(), strict=True)])
        for s in sources:
            pairs = [(-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            terms = [(b - a, t.encode()) for t, a, b, c in zip(kept, p[s], q, own[s], strict=True) if c and a > b]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for i, (v, item) in enumerate(found)]
    return sorted(out)


def some_rows(n, seed=1):
    r = np.random.default_rng(seed)
    words = [w for w in cases.words(120, 3)] + ["é", "Zz", "日本", "a'b", "x9y", "z" * 300, "zz", "z"]
    text = lambda: " ".join(words[int(k)] for k in np.minimum(r.zipf(1.4, r.integers(0, 60)) - 1, len(words) - 1))
    return [(None if i % 11 == 0 else f"l{i % 3}", None if i % 13 == 0 else f"s{int(r.integers(0, 4)) * (i % 2)}", None if i % 17 == 0 else text()) for i in range(n)]


@pytest.mark.parametrize("settings", [Settings(4, 5), Settings(3, 50, held=10, range_counters=40, block=2), Settings(10**6)])
def test_against_plain_python(spark, settings):
    """Whatever the tries, the ranges and the blocks are; with terms that none keep, the pairs are there with 0."""
    rows = some_rows(300) + [("only", "one", "x"), ("empty", "a", ""), ("empty", "b", None)] + [("l1", "s9", "zz zz Z")] * 7
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).withColumns({c: F.lit("x") for c in (*cases.CLASHING, "part", "item", "value", "rank", "low", "n", "doc_id")})
    got = divergence.audit(df, settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, settings.least_docs, settings.top)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_tries_merge_and_pack():
    r = np.random.default_rng(2)
    whole, parts = Counter(), []
    for _ in range(4):
        terms = sorted({bytes(r.integers(97, 100, r.integers(1, 9)).astype(np.uint8)) for _ in range(60)})
        n = r.integers(1, 9, len(terms))
        group = r.integers(0, 3, len(terms))
        parts.append(Trie(pa.array(terms, pa.large_binary()), np.arange(len(terms)), group, n, n))
        whole.update({(t, int(g)): int(x) for t, g, x in zip(terms, group, n, strict=True)})
    merged = Trie.merge(parts)
    for trie in (merged, Trie.unpack(merged.pack())):
        names = trie.terms.to_pylist()
        assert names == sorted(names) and {(names[k], g): x for k, g, x in zip(trie.leaf.tolist(), trie.group.tolist(), trie.n.tolist(), strict=True)} == whole
    assert len(merged.pack()) < sum(len(p.pack()) for p in parts)


def test_large_counts_are_exact():
    counts, whole = np.array([3 * 10**12, 0, 7]), np.array([9 * 10**12 + 1] * 3)
    assert divergence._shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // int(w) for c, w in zip(counts, whole, strict=True)]
