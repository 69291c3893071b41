"""The pipeline, and each stage against plain Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm.storage import Scratch

from . import cases

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs, scratch, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), Scratch(spark, "test"), {}
    bench = [" ".join(cases.split(r["text"])).lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, FOLDER), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        seen[name] = len(after)
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        texts = {i: r["text"] for i, r in before.items()}
        if name == "near_duplicates":
            groups = cases.near_duplicates(texts, 5, 80)
            assert set(after) == {i for i, c in groups.items() if i == c}
        elif name == "passages":
            for i, (w, gone) in cases.kept_words(texts).items():
                kept = [x for x, g in zip(w, gone, strict=True) if not g]
                assert (i in after) == bool(kept or not w)
                assert i not in after or after[i]["text"] == (" ".join(kept) if any(gone) else texts[i])
        elif name == "decontamination":
            leaks = {i for i, t in texts.items() if any(b in " ".join(cases.split(t)).lower() for b in bench)}
            assert not leaks & set(after) and len(before) - len(after) <= 2 * len(leaks) + 2
        elif name == "sentencepiece":
            assert set(after) == set(before) and all(r["lossless"] for r in after.values())
    assert seen["quality"] >= 150 and seen["sentencepiece"] >= 100


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names, in every stage by itself."""
    pytest.importorskip("public_tokenizers")
    texts = dict(enumerate(cases.odd_texts()))
    docs = cases.frame(spark)
    docs = docs.unionByName(docs.where("doc_id IN (2, 4, 10)")).unionByName(docs.where("doc_id = 14").withColumn("doc_id", F.lit(None).cast("long"))).cache()
    often = {i: 1 + (i in (2, 4, 10)) for i in texts}

    def ids(df):
        assert set(corpus_pipeline.COLUMNS) >= set(df.columns) or "ids" in df.columns
        return sorted((r["doc_id"] for r in df.collect()), key=repr)

    def want(kept):
        return sorted((i for i in kept for _ in range(often.get(i, 1))), key=repr)

    accepted = corpus_pipeline.keep_quality(spark, docs, FOLDER)
    assert ids(accepted) == want({r["doc_id"] for r in accepted.collect()})
    groups = cases.near_duplicates(texts, 5, 80)
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)) == want([*(i for i, c in groups.items() if i == c), None])
    left = {i for i, (w, gone) in cases.kept_words(texts).items() if not w or not all(gone)}
    assert ids(corpus_pipeline.cut_repeated_passages(spark, docs, FOLDER)) == want(left)  # the row without an id comes last, and all of it stands in 14
    assert ids(corpus_pipeline.drop_benchmark_leaks(spark, docs, FOLDER)) == want([*texts, None])
    encoded = corpus_pipeline.encode_pieces(spark, docs, FOLDER)
    assert ids(encoded) == want([*texts, None]) and all(r["lossless"] for r in encoded.collect())
    empty = cases.frame(spark, extra=False).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_leaks_without_an_id(spark):
    """A row with a null doc_id goes if its own text overlaps, and only then."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(cases.words(60, 91))
    rows = [(None, f"{clean} {item}"), (None, clean), (1, f"{item} {clean}"), (2, clean), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], cases.SCHEMA)
    got = corpus_pipeline.drop_benchmark_leaks(spark, docs, FOLDER)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(None, clean), (2, clean), (None, None)], key=repr)
