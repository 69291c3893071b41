"""Rules from tables: which is the first rule that a text's end, or any part of it, matches.

A rule has a number (``place``); of those that match, the one with the least number counts; of equal numbers that with the longest rule, then
the least rule and the least value, so that the order of rows decides nothing. Instead of testing every rule on every
text, the distinct texts are cut into the pieces that a rule could be (its ends, or its parts, of the lengths that occur among the rules),
and the pieces meet the rules in a join on equal text. So neither the number of rules nor of rows multiplies the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(place: str, *ties: Column | str) -> Column:
    """The number, then what decides between equal ones; null without a number."""
    return F.when(F.col(place).isNotNull(), F.struct(place, *ties))


def _first(df: DataFrame, column: str, rules: DataFrame, pieces) -> DataFrame:
    """The value of the first rule among the pieces of each text; lower and upper case are alike."""
    named = rules.select(F.upper("rule").alias("_rule"), F.col("place").alias("_place"), F.col("value").alias("value")).where("_rule IS NOT NULL")
    # One row for each rule text, and the few lengths that there are.
    named = named.groupBy("_rule").agg(F.min("_place").alias("_place"), F.min_by("value", _order("_place", "value")).alias("value"))
    lengths = named.agg(F.array_sort(F.collect_set(F.length("_rule"))).alias("_lengths"))
    texts = df.select(F.col(column).alias("_text")).where("_text IS NOT NULL").distinct().crossJoin(F.broadcast(lengths))  # one row
    cut = texts.withColumn("_upper", F.upper("_text")).select("_text", F.explode(F.array_distinct(pieces(F.col("_upper"), F.col("_lengths")))).alias("_rule"))
    found = cut.join(named, "_rule").groupBy("_text").agg(F.min_by("value", _order("_place", -F.length("_rule"), "_rule")).alias("value"))
    return df.join(found.withColumnRenamed("_text", column), column, "left")


def by_suffix(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Adds ``value`` of the first rule (rule, place, value) that the text ends with; an empty rule matches every text, null without one."""
    ends = lambda text, lengths: F.transform(F.filter(lengths, lambda n: n <= F.length(text)), lambda n: F.when(n == 0, "").otherwise(F.right(text, n)))
    return _first(df, column, rules, ends)


def by_phrase(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Adds ``value`` of the first rule (rule, place, value) that stands anywhere in the text. For short texts: each place is a piece for each length."""
    def parts(text, lengths):
        at = lambda n: F.when(n <= F.length(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(lengths, at))

    return _first(df, column, rules, parts)


def by_name(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Adds ``value`` of the first rule (rule, place, value) that the text is, but for case."""
    named = rules.groupBy(F.upper("rule").alias("_rule")).agg(F.min_by("value", _order("place", "value")).alias("value"))
    return df.withColumn("_rule", F.upper(column)).join(named, "_rule", "left").drop("_rule")
