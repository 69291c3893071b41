"""Answers read by what they hold: JSON as variants, each value with the type that it came with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of objects and lists that are opened; what is below stays one value.
DEPTH = 6


def _nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")


def leaves(df: DataFrame, column: str, keys: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """keys, path, kind and value (a variant) of every value in JSON text: ``$.a.b[0]``, and BIGINT, DECIMAL, DOUBLE, BOOLEAN, STRING, VOID (a null of JSON) or DATE.

    One pass: each level opens the objects and lists of the one before and leaves the rest as it is. Empty objects and lists are values of kind OBJECT and ARRAY. Text that is no
    JSON, and null, give no rows.
    """
    rows = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(column).alias("value")).where("value IS NOT NULL")
    names = "".join(f"r.{k}, " for k in keys)
    for _ in range(depth):
        rows = df.sparkSession.sql(
            f"""SELECT {names}CASE WHEN e.value IS NULL THEN r.path WHEN e.key IS NULL THEN concat(r.path, '[', e.pos, ']') ELSE concat(r.path, '.', e.key) END AS path, coalesce(e.value, r.value) AS value
            FROM {{rows}} AS r, LATERAL variant_explode_outer(CASE WHEN schema_of_variant(r.value) LIKE 'OBJECT<%' OR schema_of_variant(r.value) LIKE 'ARRAY<%' THEN r.value END) AS e""",
            rows=rows,
        )
    return rows.select(*keys, "path", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind"), "value")


def number(value: Column) -> Column:
    """The value as a number; null if it came as none."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def text(value: Column) -> Column:
    """The value as text, if it came as text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def flag(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def merged_schema(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The least schema that all values of the column, or of each group, have in common; fields that come with several types are VARIANT."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("schema"))


def insider_fields(df: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, position, field, kind, number and text of a vendor's transactions, in either of their shapes (a list, or one under ``data``)."""
    found = leaves(df, column, keys)
    inside = F.regexp_extract("path", r"^\$(?:\.data)?\[(\d+)\]\.(.+)$", 1)
    rows = found.withColumn("_p", inside).where("_p <> ''")
    return rows.select(*keys, F.col("_p").cast("int").alias("position"), F.regexp_extract("path", r"^\$(?:\.data)?\[(\d+)\]\.(.+)$", 2).alias("field"), "kind", number(F.col("value")).alias("number"), text(F.col("value")).alias("text"))
