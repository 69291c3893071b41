"""Queries over symbols, macro series, statements and prediction markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import macro, symbols
from ..functions.text import first_probability, json_strings, parse_rating
from ..operators import markets, rules, statements, timeseries
from ..sources.tables import load
from .registry import query

#: Broker spellings that the queries try, by key modulo their number.
RAW = ["XAUUSD+", "spx500", "EURUSD", "BTCUSD", "btc-usdt", "ABCDEF", "", " aapl ", "GC=F", "USDUSD", "ETH-USDC", "XUSDT", "7203.T", "0700.hk", "600519.SS", "BRK.B", "abc$", "...", "gold++", "DOTUSD"]
MACRO = ["cpi", "Fed Funds Rate", "10y-treasury", " VIX ", "dgs30", "bank of japan rate", "", "X" * 31, "M2", "gdp"]
TEXTS = ["Rating: Buy", "**Rating**: **Sell** now", "I would hold.\nRating - Underweight", "nothing here", "We Overweight this", "rating: maybe\nsell*", "Final RATING:   overweight", ""]


#: What is expected of each of them, written out.
CANONICAL = ["GC=F", "^GSPC", "EURUSD=X", "BTC-USD", "BTC-USD", "ABCDEF", "", "AAPL", "GC=F", "USDUSD=X", "ETH-USD", "XUSDT", "7203.T", "0700.HK", "600519.SS", "BRK.B", "ABC$", "...", "GC=F", "DOT-USD"]
CRYPTO_AT, UNSAFE_AT, UNSAFE_PATH_AT, REFUSED_AT = (3, 4, 10, 19), (0, 6, 7, 16, 18), (6, 7, 16, 17), (0, 16, 18)
INDEX_OF = {12: "^N225", 13: "^HSI", 14: "000001.SS"}
SERIES_OF = ["CPIAUCSL", "FEDFUNDS", "DGS10", "VIXCLS", "DGS30", None, None, None, "M2SL", "GDP"]
RATING_OF = ["Buy", "Sell", "Underweight", "Hold", "Overweight", "Sell", "Overweight", "Hold"]


def _pick(values: list[str], key: str):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({key} % {len(values)} AS INT) + 1)"


def _at(places: tuple[int, ...], n: int) -> str:
    return f"p_partkey % {n} IN ({', '.join(map(str, places))})"


@query(f"SELECT p_partkey, {_pick_sql(RAW, 'p_partkey')} AS raw, {_pick_sql(CANONICAL, 'p_partkey')} AS canonical FROM part")
def normalize_symbol(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", _pick(RAW, "p_partkey").alias("raw"))
    return df.withColumn("canonical", symbols.normalize_symbol(F.col("raw")))


@query(f"SELECT p_partkey, CASE WHEN {_at(CRYPTO_AT, 20)} THEN 'crypto' ELSE 'stock' END AS asset_class, NOT {_at(UNSAFE_AT, 20)} AS safe, NOT {_at(UNSAFE_PATH_AT, 20)} AS path_safe, NOT {_at(REFUSED_AT, 20)} AS valid_input FROM part")
def asset_class(spark, sf_dir):
    df, raw = load(spark, sf_dir, "part").select("p_partkey", _pick(RAW, "p_partkey").alias("raw")), F.col("raw")
    return df.select("p_partkey", symbols.asset_class(raw).alias("asset_class"), symbols.is_safe_symbol(raw).alias("safe"), symbols.is_path_safe(raw).alias("path_safe"), symbols.is_ticker_input(raw).alias("valid_input"))


@query(f"SELECT p_partkey, CASE p_partkey % 20 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in INDEX_OF.items())} ELSE 'SPY' END AS benchmark FROM part")
def benchmark_by_suffix(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", _pick(RAW, "p_partkey").alias("raw"))
    return df.select("p_partkey", symbols.benchmark_of(F.col("raw")).alias("benchmark"))


@query(f"SELECT p_partkey, {_pick_sql(MACRO, 'p_partkey')} AS name, {_pick_sql(SERIES_OF, 'p_partkey')} AS series FROM part")
def macro_alias(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", _pick(MACRO, "p_partkey").alias("name"))
    return df.withColumn("series", macro.series_id(F.col("name")))


_MONTHS = """m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CASE WHEN month(o_orderdate) = 6 THEN '.' ELSE CAST(CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS VARCHAR) END AS text
    FROM orders GROUP BY 1, 2, month(o_orderdate)), p AS (SELECT series, date, CASE WHEN text <> '.' THEN TRY_CAST(text AS DOUBLE) / 100 END AS value FROM m)"""


def _months(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("date")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).cast("bigint").cast("string").alias("text"))
    o = o.withColumn("text", F.when(F.month("date") == 6, ".").otherwise(F.col("text")))
    return o.select("series", "date", (macro.observed(F.col("text")) / 100).alias("value"))


@query(f"""WITH {_MONTHS} SELECT series, count(*) AS n, min(date) AS first_date, round(arg_min(value, date), 2) AS first_value, max(date) AS last_date, round(arg_max(value, date), 2) AS last_value,
    round(arg_max(value, date) - arg_min(value, date), 2) AS delta, round(100 * (arg_max(value, date) - arg_min(value, date)) / nullif(arg_min(value, date), 0), 4) AS pct FROM p WHERE value IS NOT NULL GROUP BY series""")
def series_change(spark, sf_dir):
    out = timeseries.change_over_window(_months(spark, sf_dir))
    return out.select("series", "n", "first_date", F.round("first_value", 2).alias("first_value"), "last_date", F.round("last_value", 2).alias("last_value"), F.round("delta", 2).alias("delta"), F.round("pct", 4).alias("pct"))


@query(f"WITH {_MONTHS} SELECT series, date, round(value, 2) AS value FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 40")
def series_recent(spark, sf_dir):
    some = _months(spark, sf_dir).where("value IS NOT NULL")
    return timeseries.recent(some, 40, ("series",), [F.col("date").desc()]).withColumn("value", F.round("value", 2))


_YEARS = range(1995, 2002)


@query("""SELECT o_orderpriority AS line_item, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period_end, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS value FROM orders
    WHERE year(o_orderdate) BETWEEN 1995 AND 2001 AND make_date(CAST(year(o_orderdate) AS INT), 12, 31) <= DATE '1999-12-31' GROUP BY 1, 2""")
def statement_unpivot_asof(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    wide = o.groupBy(F.col("o_orderpriority").alias("line_item")).agg(*((F.sum(F.when(F.year("o_orderdate") == y, F.col("cents"))).cast("double") / 100).alias(f"{y}-12-31") for y in _YEARS))
    long = statements.known_periods(statements.unpivot_periods(wide, ("line_item",)), "1999-12-31")
    return long.withColumn("value", F.round("value", 2))


@query("""SELECT s_suppkey AS symbol, f AS field, v AS value FROM (SELECT s_suppkey, unnest(['Name', 'Sector', 'Market Cap']) AS f, unnest([s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END,
    CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR)]) AS v FROM supplier) WHERE v IS NOT NULL""")
def profile_fields(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    wide = s.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("longName"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("sector"), F.floor("s_acctbal").alias("marketCap"))
    return statements.profile_rows(wide)


@query("""SELECT p_partkey, p_name, round(coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END, 0), 2) AS volume FROM part ORDER BY coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END, 0) DESC, p_partkey LIMIT 25""")
def topk_null_as_zero(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("v", F.coalesce(F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")), F.lit(0.0)))
    return p.orderBy(F.col("v").desc(), "p_partkey").limit(25).select("p_partkey", "p_name", F.round("v", 2).alias("volume"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'oops' WHEN 2 THEN '[]' ELSE '["0.' || CAST(event_id % 100 AS VARCHAR) || '", "x"]' END AS prices, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 5 >= 3 THEN TRY_CAST(json_extract_string(prices, '$[0]') AS DOUBLE) END AS probability, k FROM t""")
def json_array_probability(spark, sf_dir):
    e, m = load(spark, sf_dir, "events"), F.col("event_id") % 5
    raw = F.when(m == 1, "oops").when(m == 2, "[]").when(m >= 3, F.concat(F.lit('["0.'), (F.col("event_id") % 100).cast("string"), F.lit('", "x"]')))
    prices = json_strings(raw)
    return e.select("event_id", F.size(prices).alias("n"), first_probability(prices).alias("probability"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))


def _answers(spark, sf_dir):
    """Orders as events with their lines as markets."""
    li = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("d"), F.max("l_linestatus").alias("s"))
    price = F.concat(F.lit('["0.'), F.col("q").cast("int").cast("string"), F.lit('", "0.5"]'))
    market = F.struct(
        F.col("l_linenumber").alias("id"), F.lit('["Yes", "No"]').alias("outcomes"), F.when(F.col("q") > 2, price).alias("outcomePrices"), F.when(F.col("q") != 7, F.col("q")).alias("volumeNum"),
        F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("endDate"), (F.col("s") == "F").alias("closed"),
    )
    per_order = li.groupBy("l_orderkey").agg(F.struct(F.array_sort(F.collect_list(market)).alias("markets")).alias("e"))
    return per_order.select("l_orderkey", F.array("e").alias("events"))


_MARKETS = """l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_shipdate) AS d, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
    f AS (SELECT * FROM l WHERE s <> 'F' AND d >= TIMESTAMP '1998-01-01 00:00:00' AND q > 2)"""


@query(f"WITH {_MARKETS} SELECT l_orderkey, l_linenumber AS id, CASE WHEN q <> 7 THEN q END AS volume FROM f")
def unnest_markets(spark, sf_dir):
    rows = markets.unnest_markets(_answers(spark, sf_dir), keys=("l_orderkey",))
    return rows.where(markets.is_forward_looking("1998-01-01")).select("l_orderkey", "id", F.col("volumeNum").alias("volume"))


@query(f"""WITH {_MARKETS} SELECT l_orderkey, l_linenumber AS id, CASE WHEN q <> 7 THEN q ELSE 0 END AS volume, TRY_CAST('0.' || CAST(CAST(q AS INT) AS VARCHAR) AS DOUBLE) AS probability, 'Yes' AS label FROM f
    ORDER BY CASE WHEN q <> 7 THEN q ELSE 0 END DESC, l_orderkey, l_linenumber LIMIT 50""")
def top_markets(spark, sf_dir):
    rows = markets.unnest_markets(_answers(spark, sf_dir), keys=("l_orderkey",)).where(markets.is_forward_looking("1998-01-01"))
    return markets.top_markets(rows, 50, order=("l_orderkey", "id")).select("l_orderkey", "id", "volume", "probability", "label")


@query(f"SELECT p_partkey, {_pick_sql(TEXTS, 'p_partkey')} AS text, {_pick_sql(RATING_OF, 'p_partkey')} AS rating FROM part")
def parse_ratings(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", _pick(TEXTS, "p_partkey").alias("text"))
    return df.withColumn("rating", parse_rating(F.col("text")))


@query("SELECT o_orderkey, substr(sha256(upper(o_orderpriority) || ':' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), 1, 16) AS thread FROM orders")
def thread_key(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", symbols.thread_key(F.col("o_orderpriority"), F.to_date("o_orderdate")).alias("thread"))


_RULES = """w AS (SELECT string_split(p_name, ' ')[2] AS rule, min(p_partkey) AS k, max(p_brand) AS value FROM part GROUP BY 1),
    rules AS (SELECT rule, 10 + k AS place, value FROM w UNION ALL SELECT right(rule, 2), CASE WHEN rule < 'n' THEN 5 ELSE 1000000 END + k, 'end of ' || rule FROM w UNION ALL SELECT upper(left(p_name, 3)), 500000 + min(p_partkey), 'start of ' || max(p_name) FROM part GROUP BY 1 UNION ALL SELECT '', 2000000, 'none')"""


def _name_rules(spark, sf_dir):
    """Rules from the names of parts: their last words, the ends and the starts of those, and an empty one that matches last."""
    p = load(spark, sf_dir, "part")
    words = p.groupBy(F.element_at(F.split("p_name", " "), 2).alias("rule")).agg(F.min("p_partkey").alias("k"), F.max("p_brand").alias("value"))
    ends = words.select(F.right("rule", F.lit(2)).alias("rule"), (F.when(F.col("rule") < "n", 5).otherwise(1000000) + F.col("k")).alias("place"), F.concat(F.lit("end of "), "rule").alias("value"))
    starts = p.groupBy(F.upper(F.left("p_name", F.lit(3))).alias("rule")).agg((F.min("p_partkey") + 500000).alias("place"), F.concat(F.lit("start of "), F.max("p_name")).alias("value"))
    last = p.groupBy(F.lit("").alias("rule")).agg(F.lit(2000000).cast("long").alias("place"), F.lit("none").alias("value"))
    return words.select("rule", (F.col("k") + 10).alias("place"), "value").unionByName(ends).unionByName(starts).unionByName(last)


@query(f"""WITH {_RULES}, n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_type END AS name FROM part),
    d AS (SELECT DISTINCT name FROM n), m AS (SELECT name, arg_min(value, place) AS value FROM d JOIN rules ON suffix(upper(name), upper(rule)) GROUP BY name) SELECT n.p_partkey, n.name, m.value FROM n LEFT JOIN m USING (name)""")
def suffix_rules(spark, sf_dir):
    """Texts and rules from the tables; of several rules that end a text the least number wins."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_type"))
    return rules.by_suffix(load(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", _name_rules(spark, sf_dir)).select("p_partkey", "name", "value")


@query(f"""WITH {_RULES}, n AS (SELECT p_partkey, p_type || ' ' || p_name || ' ' || p_brand AS name FROM part), d AS (SELECT DISTINCT name FROM n),
    m AS (SELECT name, arg_min(value, place) AS value FROM d JOIN rules ON rule <> '' AND contains(upper(name), upper(rule)) GROUP BY name) SELECT n.p_partkey, m.value FROM n LEFT JOIN m USING (name)""")
def phrase_rules(spark, sf_dir):
    texts = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("name"))
    return rules.by_phrase(texts, "name", _name_rules(spark, sf_dir).where("rule <> ''")).select("p_partkey", "value")
