"""Answers of vendors as JSON text, flattened to tables.

Every function takes a DataFrame with a column of answers and the columns to keep beside it.
An answer that is no JSON, or lacks the part, gives no rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import macro
from ..operators import cleaning, markets, news, statements

ARTICLE = (
    "content struct<title:string,summary:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>,pubDate:string>,"
    "title string, summary string, publisher string, link string, providerPublishTime bigint"
)
MARKETS = "events array<struct<markets:array<struct<question:string,outcomes:string,outcomePrices:string,volumeNum:double,endDate:string,closed:boolean,oneWeekPriceChange:double>>>>"
MESSAGES = "messages array<struct<created_at:string,user:struct<username:string>,entities:struct<sentiment:struct<basic:string>>,body:string>>"
POSTS = "data struct<children:array<struct<data:struct<title:string,score:int,num_comments:int,created_utc:double,selftext:string>>>>"
SERIES = "seriess array<struct<id:string,title:string,units:string,units_short:string,frequency:string,seasonal_adjustment_short:string>>"
OBSERVATIONS = "observations array<struct<date:string,value:string>>"
REPORTS = "annualReports array<map<string,string>>, quarterlyReports array<map<string,string>>"
FEED = "feed array<struct<title:string,summary:string,source:string,url:string,time_published:string>>"


def _parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("_a", F.from_json(column, schema))


def articles(df: DataFrame, column: str) -> DataFrame:
    """Arrays of articles, nested or flat."""
    rows = df.select(F.explode(F.from_json(column, f"array<struct<{_struct(ARTICLE)}>>")).alias("_r")).select("_r.*")
    return news.flatten_articles(rows)


def _struct(ddl: str) -> str:
    """A column list as the inside of a struct."""
    depth, out, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += c
    return ",".join(out)


def feed_articles(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The other vendor's feed, with compact times."""
    rows = _parsed(df, column, FEED).select(*keys, F.posexplode("_a.feed").alias("position", "_r"))
    published = F.try_to_timestamp("_r.time_published", F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    return rows.select(*keys, "position", "_r.title", "_r.summary", F.col("_r.source").alias("publisher"), F.col("_r.url").alias("link"), published.alias("published"))


def macro_series(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = _parsed(df, column, SERIES).select(*keys, F.explode("_a.seriess").alias("_r"))
    return rows.select(*keys, F.col("_r.id").alias("series"), "_r.title", F.coalesce("_r.units_short", "_r.units").alias("units"), "_r.frequency", F.col("_r.seasonal_adjustment_short").alias("adjustment"))


def macro_observations(df: DataFrame, column: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Dates and values; missing tokens go."""
    rows = _parsed(df, column, OBSERVATIONS).select(*keys, F.explode("_a.observations").alias("_r"))
    return rows.select(*keys, F.col("_r.date").try_cast("date").alias("date"), macro.observed(F.col("_r.value")).alias("value")).where("value IS NOT NULL")


def market_search(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return markets.unnest_markets(_parsed(df, column, MARKETS).select(*keys, "_a.events"), keys=keys)


def social_stream(df: DataFrame, column: str) -> DataFrame:
    return news.social_messages(_parsed(df, column, MESSAGES).select(F.explode("_a.messages").alias("_r")).select("_r.*"))


def forum_search(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Posts with their scores; what is missing stays null, which is not 0."""
    rows = _parsed(df, column, POSTS).select(*keys, F.posexplode("_a.data.children").alias("position", "_r"))
    d = "_r.data."
    return rows.select(*keys, "position", F.coalesce(d + "title", F.lit("")).alias("title"), d + "score", d + "num_comments", F.col(d + "created_utc").cast("long").alias("created_utc"), F.coalesce(d + "selftext", F.lit("")).alias("selftext"), F.lit("json").alias("source"))


def statement_reports(df: DataFrame, column: str, at=None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Line items of annual and quarterly reports that had ended at the date: keys, freq, period_end, line_item, value."""
    a = _parsed(df, column, REPORTS)
    out = None
    for freq, name in (("annual", "annualReports"), ("quarterly", "quarterlyReports")):
        rows = a.select(*keys, F.lit(freq).alias("freq"), F.col(f"_a.{name}").alias("reports"))
        rows = statements.known_reports(rows, "reports", at) if at is not None else rows
        rows = statements.report_rows(rows, "reports", (*keys, "freq"))
        out = rows if out is None else out.unionByName(rows)
    return out


def profile(df: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Labelled fields of a profile."""
    fields = statements.PROFILE.values()
    wide = df.withColumn("_a", F.from_json(column, "map<string,string>")).select(*keys, *(F.try_element_at("_a", F.lit(f)).alias(f) for f in fields))
    return statements.profile_rows(wide, keys)


def insider_rows(df: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Transactions as maps: their fields are the vendor's own."""
    return df.select(*keys, F.posexplode(F.from_json(F.get_json_object(column, "$.data"), "array<map<string,string>>")).alias("position", "fields"))


def insider_table(df: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The same from the vendor whose answer is the list itself. An empty list is an answer without rows, and no error."""
    return df.select(*keys, F.posexplode(F.from_json(column, "array<map<string,string>>")).alias("position", "fields"))


def output_size(start, today) -> str:
    """Which length of series to ask for: the compact one has the last hundred days."""
    return "compact" if (date.fromisoformat(str(today)) - date.fromisoformat(str(start))).days < 100 else "full"


def daily_csv(df: DataFrame, column: str, start, end, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars from CSV text with a header whose first column is the date, between the bounds; lines that are no bars go."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(column), r"\r?\n")).alias("_line", "_text")).where("_line > 0 AND trim(_text) <> ''")
    bars = lines.select(*keys, F.from_csv("_text", "date string, open string, high string, low string, close string, volume string").alias("_r")).select(*keys, "_r.*")
    return cleaning.between(cleaning.coerce(bars), start, end)
