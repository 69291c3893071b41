"""News, forum posts and social messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import from_epoch, parsed_instant
from ..functions.text import one_line, strip_markup, truncate


def flatten_articles(articles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, title, summary, publisher, link, published of articles that come nested (under ``content``) or flat."""
    a, c = F.col, F.col("content")
    nested = c.isNotNull()
    link = F.coalesce(c["canonicalUrl"]["url"], c["clickThroughUrl"]["url"], F.lit(""))
    pick = lambda inside, flat, missing: F.when(nested, F.coalesce(inside, F.lit(missing))).otherwise(F.coalesce(flat, F.lit(missing)))
    return articles.withColumns(
        {
            "_title": pick(c["title"], a("title"), "No title"),
            "_summary": pick(c["summary"], a("summary"), ""),
            "_publisher": pick(c["provider"]["displayName"], a("publisher"), "Unknown"),
            "_link": F.when(nested, link).otherwise(F.coalesce(a("link"), F.lit(""))),
            "_published": F.when(nested, parsed_instant(c["pubDate"])).otherwise(from_epoch(a("providerPublishTime"))),
        }
    ).select(*keys, F.col("_title").alias("title"), F.col("_summary").alias("summary"), F.col("_publisher").alias("publisher"), F.col("_link").alias("link"), F.col("_published").alias("published"))


def in_window(published: Column, start, end, live: bool = False) -> Column:
    """Published from the start to a day after the end, both included; undated articles only in a live window."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    first, last = first.cast("timestamp_ntz"), last.cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return F.when(published.isNotNull(), published.between(first, last)).otherwise(F.lit(live))


def ordered_union(frames: list[DataFrame], order: list | None = None) -> DataFrame:
    """All rows of results of several queries with query_no and position in each; without a column ``position``, the order gives it."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("query_no", F.lit(k))
        if "position" not in df.columns:
            if not order:
                raise ValueError("rows have no order by themselves: give a column position or an order")
            df = df.withColumn("position", F.row_number().over(W.partitionBy("query_no").orderBy(*order)) - 1)
        out = df if out is None else out.unionByName(df)
    return out


def ticker_news(articles: DataFrame, start, end, limit: int = 20, live: bool = False) -> DataFrame:
    """Of the first ``limit`` articles by position, those in the window."""
    return limit_then_filter(articles, ["position"], limit, in_window(F.col("published").cast("timestamp_ntz"), start, end, live))


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key: the first in order. Rows with a null or empty key go. By one aggregate, so a common key costs a row for each task."""
    rest = [c for c in df.columns if c != key]
    some = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return some.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)


def keep_first_known(df: DataFrame, key: str, order: list) -> DataFrame:
    """The same, but rows with a null key all stay."""
    return keep_first(df.where(F.col(key).isNotNull()), key, order).unionByName(df.where(F.col(key).isNull()))


def dedup_top(df: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct keys in order."""
    return keep_first(df, key, order).orderBy(*order).limit(limit)


def limit_then_filter(df: DataFrame, order: list[str], limit: int, keep: Column) -> DataFrame:
    """Filters the first ``limit`` rows, so fewer may be left. The limit is a column of its own: no rule can move the filter before it."""
    first = df.orderBy(*order).limit(limit).withColumn("_in", F.lit(True))
    return first.where(F.col("_in") & keep).drop("_in")


def sentiment_mix(messages: DataFrame, label: str, by: tuple[str, ...] = (), limit: int | None = None, order: list | None = None) -> DataFrame:
    """Counts of Bullish, Bearish and other messages, total, and whole percents (half to even; the others stay in the total)."""
    if limit is not None:
        messages = messages.orderBy(*(order or [])).limit(limit) if not by else messages.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= limit)
    bull, bear = F.count_if(F.col(label) == "Bullish"), F.count_if(F.col(label) == "Bearish")
    out = messages.groupBy(*by).agg(bull.alias("bullish"), bear.alias("bearish"), F.count(F.lit(1)).alias("total"))
    out = out.withColumn("unlabeled", F.col("total") - F.col("bullish") - F.col("bearish"))
    pct = lambda c: F.coalesce(F.bround(F.try_divide(100.0 * F.col(c), F.col("total"))), F.lit(0.0)).cast("int")
    return out.withColumn("bullish_pct", pct("bullish")).withColumn("bearish_pct", pct("bearish"))


def social_messages(df: DataFrame, longest: int = 280) -> DataFrame:
    """created_at, username, sentiment, body of nested messages."""
    return df.select(
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce(F.col("user.username"), F.lit("?")).alias("username"),
        F.col("entities.sentiment.basic").alias("sentiment"),
        truncate(one_line(F.coalesce("body", F.lit(""))), longest).alias("body"),
    )


def forum_posts(entries: DataFrame) -> DataFrame:
    """Posts from feed entries: the feed has no scores and comments, so they stay null."""
    kept = [c for c in entries.columns if c not in ("title", "published", "content")]
    return entries.select(
        *kept,
        F.coalesce("title", F.lit("")).alias("title"),
        F.lit(None).cast("int").alias("score"),
        F.lit(None).cast("int").alias("num_comments"),
        F.unix_seconds(F.try_to_timestamp("published")).alias("created_utc"),
        strip_markup(F.coalesce("content", F.lit(""))).alias("selftext"),
        F.lit("rss").alias("source"),
    )


def forum_summary(posts: DataFrame, by: tuple[str, ...] = ("forum",)) -> DataFrame:
    return posts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_posts"), F.bool_or(F.coalesce(F.col("source") == "rss", F.lit(False))).alias("via_feed"))
