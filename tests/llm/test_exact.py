"""The digest index and exact duplicates."""

import hashlib

from pyspark.sql import functions as F

from marlstone.llm import exact, queries

from ..compare import difference
from . import cases

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected(rows):
    """keep_id, size, kept and digest of (doc_id, text) pairs, by plain Python."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(t)))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql(spark):
    assert difference(spark, FOLDER, queries.op13_exact, queries.OP13_SQL) == ""


def test_odd_rows(spark):
    """Null and empty texts, rows without an id, repeated rows, one id with two texts, extra columns with clashing names."""
    rows = list(enumerate(cases.odd_texts())) + [(None, "one"), (None, "only here"), (None, "only here"), (3, ""), (40, "x"), (40, "y"), (40, "x"), (41, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in (*cases.CLASHING, "digest", "keep_id", "copies", "fresh", "batch")})
    for arrivals in (1, 2, 5):
        assert found(exact.exact_duplicates(df.repartition(3), arrivals)) == expected(rows)


def test_empty(spark):
    assert found(exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_one_text_holds_most_rows(spark):
    """Frequent digests go by broadcast, the others by the join: the same rows on both ways."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise((F.col("id") % 600).cast("string")).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(exact.exact_duplicates(df)) == expected(rows)


def test_later_batches(spark, tmp_path):
    """New data against an index of an earlier session; a repeated batch changes nothing."""
    path = f"file://{tmp_path}/index"
    rows = lambda *pairs: exact.digests(spark.createDataFrame(list(pairs), "doc_id long, text string"))
    index = exact.DigestIndex(spark, path, buckets=4)
    assert {r["doc_id"] for r in index.add(rows((1, "a"), (2, "b"), (3, "b")), 0).collect()} == {1, 3}
    assert {r["doc_id"] for r in index.add(rows((4, "a"), (5, "c")), 1).collect()} == {5}
    spark.sql(f"DROP TABLE {index.table}")
    spark.sql(f"DROP TABLE {index.table}_staged")
    again = exact.DigestIndex(spark, path, buckets=99)
    assert again.buckets == 4
    before = sorted(tuple(r) for r in again.rows().collect())
    assert {r["doc_id"] for r in again.add(rows((4, "a"), (5, "c")), 1).collect()} == {5}
    assert sorted(tuple(r) for r in again.rows().collect()) == before
    assert again.add(rows((6, "b"), (7, "c")), 2).isEmpty() and again.add(rows((8, "x")).limit(0), 3).isEmpty()
    want = {sha("a"): (1, 2), sha("b"): (3, 3), sha("c"): (5, 2)}
    assert {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in again.groups().collect()} == want
    plan = again.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
