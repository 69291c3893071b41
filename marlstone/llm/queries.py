"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfile import tokenize_documents

    return tokenize_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import Settings, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Settings(words=3, percent=85))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def _times(share: float):
    return lambda x: x * share


def planted_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's operator where links are many: each vector with two more that lean towards the next one, so chains form."""
    from pyspark.sql import functions as F

    from .embeddings import near_duplicate_vectors

    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    both = e.join(after, "vec_id")
    for k, share in ((1, 0.2), (2, 0.35)):
        towards = F.zip_with("embedding", F.transform("w", _times(share)), lambda v, w: v + w)
        e = e.unionByName(both.select((F.col("vec_id") + k * 1_000_000).alias("vec_id"), towards.alias("embedding")))
    return near_duplicate_vectors(e)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import Settings, encode

    columns = ("n_tokens", "ids_crc32", "decoded_crc32", "lossless")
    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), Settings(seed=29, dropout=0.1), columns)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": op1_embeddings,
        "op2_token_output": op2_token_output,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_licenses": op4_licenses,
        "op5_html": op5_html,
        "op6_sharding": op6_sharding,
        "op7_minhash": op7_minhash,
        "op8_decontamination": op8_decontamination,
        "op9_quality": op9_quality,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_alignment": op11_alignment,
        "op12_divergence": op12_divergence,
        "op13_exact": op13_exact,
        "planted_vector_links": planted_vector_links,
    }


_REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

#: All pairs of vectors in double precision; components by following links.
OP1_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH},
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""

_PLANTED = """o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.vec_id, list_zip(x.e, y.e) AS z FROM o x JOIN o y ON y.vec_id = x.vec_id + 1),
    planted AS (SELECT vec_id, e AS embedding FROM o UNION ALL SELECT vec_id + 1000000, list_transform(z, lambda v: v[1] + 0.2::DOUBLE * v[2]) FROM p UNION ALL SELECT vec_id + 2000000, list_transform(z, lambda v: v[1] + 0.35::DOUBLE * v[2]) FROM p)"""
PLANTED_SQL = OP1_SQL.replace("FROM embeddings", "FROM planted").replace("WITH RECURSIVE v AS", f"WITH RECURSIVE {_PLANTED}, v AS")

#: Shared shingles counted for every two documents that have any.
OP7_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w, ' ') END AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), {_REACH}, m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""

#: Every window of 20 words with its text; those that come again cover their words.
OP10_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 18, 1))) AS u(i)),
    d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1), c AS (SELECT DISTINCT doc_id, i + j AS i FROM d, range(20) AS u(j)),
    o AS (SELECT doc_id, i, w[i] AS x FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
    k AS (SELECT o.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.i = o.i WHERE c.i IS NULL GROUP BY 1)
    SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


#: Every group's count of every kept term, zeros included, in whole numbers.
OP12_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    o AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY 1, 2, 3), k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY 1, 2 HAVING sum(docs) >= 30),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
    n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2), nl AS (SELECT lang, sum(n) AS n FROM n GROUP BY 1),
    p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.c, 1 + (1000000000 * (c.c + 5)) // (n.n + 5 * v.v) AS p FROM c JOIN n ON n.lang = c.lang AND n.source = c.source JOIN v ON v.lang = c.lang),
    q AS (SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.c) + 5)) // (any_value(nl.n) + 5 * any_value(v.v)) AS q FROM c JOIN nl ON nl.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY 1, 2),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 4
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source WHERE a.lang NOT IN (SELECT lang FROM v)
    UNION ALL SELECT p.lang, p.source, 'term', p.term, p - q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f QUALIFY part = 'pair' OR rank <= 50"""

#: Equal texts as groups of a window.
OP13_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict[str, str]:
    """SQL counterparts where SQL can express a query and runs over whole tables; the others are tested against plain Python."""
    return {"op1_embeddings": OP1_SQL, "planted_vector_links": PLANTED_SQL, "op7_minhash": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op12_divergence": OP12_SQL, "op13_exact": OP13_SQL}
