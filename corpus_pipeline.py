"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as
Parquet in the shared folder and read again. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, neardup, pieces, quality, substrings
from marlstone.llm.components import small
from marlstone.llm.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Names a row by what it holds, whether it has a doc_id or not.
_ROW = "xxhash64(doc_id, text)"


def _without(docs: DataFrame, gone: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """docs but for those whose key is a doc_id of ``gone``, which is written first; broadcast if its counted rows are within the bound."""
    gone = Scratch(docs.sparkSession, "pipeline").save(gone.select(F.col("doc_id").alias("_key")).where("_key IS NOT NULL").distinct(), name)
    return docs.withColumn("_key", F.expr(key)).join(small(gone, gone.count()), "_key", "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its own text, a null one as empty, so repeated rows share their fate and a null doc_id
    changes nothing. Without usable labels every row stays; an empty table gives an empty table.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id.

    Texts without words, null ones and rows with a null doc_id stay. Repeated rows are one document and stay or go
    together. An empty table gives an empty table.
    """
    found = neardup.near_duplicates(docs, neardup.Settings(words=5, percent=80))
    return _without(docs, found.where("NOT kept"), "duplicates")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier in the corpus; those with no words left go.

    A text that loses no word stays as it is, but for a null one, which becomes empty; another one becomes its kept words,
    joined by one blank. Repeated rows don't take words from one another; rows with a null doc_id come after all others. An
    empty table gives an empty table.
    """
    found = substrings.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    out = found.where("n_words > n_removed OR n_words = 0")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't overlap with a benchmark item, each row by itself: rows without a doc_id, too.

    Null and empty texts stay, repeated rows stay or go together; an empty table, or one without benchmark items, stays as it is.
    """
    rows = docs.select(F.expr(_ROW).alias("doc_id"), "text")
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found, "leaks", _ROW)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their checksum and whether they decode to its text.

    A null text counts as empty and has no ids; repeated rows have equal ids, a null doc_id counts as 0. An empty table
    gives an empty table.
    """
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), pieces.Settings(), ("ids", "n_tokens", "ids_crc32", "lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the classifier, the components or the segmentation; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
