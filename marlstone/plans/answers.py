"""Queries over vendors' answers, logs and feeds as text, made from the tables; and over the request API.

Each query writes rows as the text that a vendor would send and reads it back; its SQL takes
the values straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import dates, render, symbols, text
from ..operators import checkpoints, identity, indicators, news, telemetry, timeseries
from ..sources import files, payloads, routing, typed, vendor_answers
from ..sources.tables import event_bars, load
from ..sources.work import work_folder
from .market import BARS, USERS
from .records import _STATUS, _reports
from .registry import query

def _none() -> Column:
    return F.lit(None).cast("string")


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields))


@query("""SELECT d.doc_id, d.source AS symbol, p.position, CASE p.position WHEN 0 THEN d.text ELSE 'second' END AS title, CASE p.position WHEN 0 THEN d.lang END AS publisher,
    CASE WHEN p.position = 0 AND d.doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01 10:15:00' + INTERVAL 1 DAY * CAST(d.doc_id % 60 AS INT) END AS published FROM documents d, (VALUES (0), (1)) AS p(position)""")
def feed_articles(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    at = F.when(F.col("doc_id") % 7 == 0, "never").otherwise(F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyyMMdd"), F.lit("T101500")))
    fields = ("title", "summary", "source", "url", "time_published")
    one = F.struct(*(v.alias(n) for n, v in zip(fields, (F.col("text"), _none(), F.col("lang"), F.lit("u"), at), strict=True)))
    two = F.struct(*(v.alias(n) for n, v in zip(fields, (F.lit("second"), _none(), _none(), _none(), _none()), strict=True)))
    answers = d.select("doc_id", F.col("source").alias("symbol"), _json(F.array(one, two).alias("feed")).alias("answer"))
    return payloads.feed_articles(answers, "answer", ("doc_id", "symbol")).select("doc_id", "symbol", "position", "title", "publisher", "published")


@query("""SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN coalesce(text, 'No title') ELSE text END AS title, CASE WHEN doc_id % 3 = 0 AND lang = 'en' THEN 'Unknown' ELSE lang END AS publisher, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS link,
    CASE WHEN doc_id % 3 = 2 THEN TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(doc_id * 1000 AS BIGINT) ELSE TIMESTAMP '2025-05-05 08:00:00' END AS published FROM documents""")
def articles_nested_or_flat(spark, sf_dir):
    d, kind = load(spark, sf_dir, "documents"), F.col("doc_id") % 3
    nested = F.struct(
        F.col("text").alias("title"), _none().alias("summary"), F.struct(F.when((kind == 0) & (F.col("lang") == "en"), None).otherwise(F.col("lang")).alias("displayName")).alias("provider"),
        F.struct(F.when(kind == 0, "a").alias("url")).alias("canonicalUrl"), F.struct(F.lit("b").alias("url")).alias("clickThroughUrl"), F.lit("2025-05-05T10:00:00+02:00").alias("pubDate"),
    )
    flat = kind == 2
    article = F.struct(F.when(~flat, nested).alias("content"), F.when(flat, F.col("text")).alias("title"), F.when(flat, F.col("lang")).alias("publisher"), F.when(flat, "c").alias("link"), F.when(flat, F.col("doc_id") * 1000).alias("providerPublishTime"))
    rows = d.select("doc_id", F.from_json(F.to_json(article), payloads.ARTICLE).alias("_a")).select("doc_id", "_a.*")
    return news.flatten_articles(rows, ("doc_id",)).drop("summary")


@query("""SELECT o_orderkey AS symbol, 0 AS position, CAST(o_totalprice AS VARCHAR) AS value, o_orderstatus AS kind FROM orders WHERE o_orderkey % 4 <> 0
    UNION ALL SELECT o_orderkey, 1, NULL, 'second' FROM orders WHERE o_orderkey % 4 <> 0""")
def insider_transactions(spark, sf_dir):
    """Both vendors' shapes; every fourth list is empty and gives no rows."""
    o = load(spark, sf_dir, "orders")
    row = lambda value, kind: F.struct(value.alias("value"), kind.alias("kind"))
    rows = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<struct<value:string,kind:string>>")).otherwise(F.array(row(F.col("o_totalprice").cast("string"), F.col("o_orderstatus")), row(_none(), F.lit("second"))))
    listed = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("symbol"), F.to_json(rows).alias("answer"))
    inside = o.where("o_orderkey % 2 <> 0").select(F.col("o_orderkey").alias("symbol"), _json(rows.alias("data")).alias("answer"))
    out = payloads.insider_table(listed, "answer").unionByName(payloads.insider_rows(inside, "answer"))
    return out.select("symbol", "position", F.try_element_at("fields", F.lit("value")).alias("value"), F.try_element_at("fields", F.lit("kind")).alias("kind"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS created_at, CASE WHEN role = 'user' THEN 'user' ELSE '?' END AS username, CASE turn % 3 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' END AS sentiment,
    CASE WHEN length(b) > 280 THEN left(b, 280) || '…' ELSE b END AS body FROM (SELECT *, trim(replace(coalesce(text, ''), chr(10), ' ')) AS b FROM conversations)""")
def social_stream(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    user = F.struct(F.when(F.col("role") == "user", F.col("role")).alias("username"))
    mood = F.struct(F.struct(F.when(F.col("turn") % 3 == 0, "Bullish").when(F.col("turn") % 3 == 1, "Bearish").alias("basic")).alias("sentiment"))
    message = F.struct(F.col("conv_id").cast("string").alias("created_at"), user.alias("user"), mood.alias("entities"), F.col("text").alias("body"))
    return payloads.social_stream(c.select(_json(F.array(message).alias("messages")).alias("answer")), "answer")


@query("""SELECT doc_id AS forum, 0 AS position, coalesce(lang, '') AS title, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 100 AS INT) END AS score, CASE WHEN doc_id % 3 = 0 THEN 0 END AS num_comments, doc_id AS created_utc, coalesce(text, '') AS selftext, 'json' AS source FROM documents""")
def forum_search(spark, sf_dir):
    d, k = load(spark, sf_dir, "documents"), F.col("doc_id")
    post = F.struct(F.col("lang").alias("title"), F.when(k % 5 != 0, k % 100).alias("score"), F.when(k % 3 == 0, 0).alias("num_comments"), k.cast("double").alias("created_utc"), F.col("text").alias("selftext"))
    answer = _json(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))
    return payloads.forum_search(d.select(k.alias("forum"), answer.alias("answer")), "answer", ("forum",))


def _feeds(spark, sf_dir):
    """Each part as a feed of two entries."""
    p = load(spark, sf_dir, "part")
    entry = "<entry><title>{}</title><published>2026-01-01T00:00:00{}</published><content type='html'>{}</content></entry>"
    content = "&lt;!-- SC_OFF --&gt;&lt;p&gt;it&amp;#39;s {} &amp;amp; caf&amp;eacute;&lt;/p&gt;&lt;!-- SC_ON --&gt; tail"
    key = F.col("p_partkey").cast("string")
    fill = lambda pattern, *values: F.concat(*(x for pair in zip((F.lit(v) for v in pattern.split("{}")), (*values, F.lit("")), strict=True) for x in pair))
    zone = F.when(F.col("p_partkey") % 2 == 0, "Z").otherwise("+01:00")
    xml = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), fill(entry, key, zone, fill(content, key)), F.lit("<entry><title>two</title></entry></feed>"))
    return files.feed_entries(p.select(F.col("p_partkey").alias("forum"), xml.alias("xml")), "xml")


@query("""SELECT p_partkey AS forum, 0 AS position, CAST(p_partkey AS VARCHAR) AS title, CASE WHEN p_partkey % 2 = 0 THEN 1767225600::BIGINT ELSE 1767222000 END AS created_utc, 'it''s ' || p_partkey || ' & café' AS selftext FROM part
    UNION ALL SELECT p_partkey, 1, 'two', NULL, '' FROM part""")
def forum_feed(spark, sf_dir):
    return news.forum_posts(_feeds(spark, sf_dir)).select("forum", "position", "title", "created_utc", "selftext")


@query("SELECT p_partkey AS forum, 2::BIGINT AS n_posts, true AS via_feed FROM part")
def forum_counts(spark, sf_dir):
    return news.forum_summary(news.forum_posts(_feeds(spark, sf_dir)))


@query("""WITH r AS (SELECT s_suppkey, y, f, CASE f WHEN 'annual' THEN make_date(y, 12, 31) ELSE make_date(y, 3, 31) END AS period_end FROM supplier, (VALUES (2023), (2024), (2025)) t(y), (VALUES ('annual'), ('quarterly')) u(f))
    SELECT s_suppkey AS symbol, f AS freq, period_end, 'cash' AS line_item, CAST(s_suppkey * y AS DOUBLE) AS value FROM r WHERE period_end <= DATE '2024-12-31' UNION ALL SELECT s_suppkey, 'annual', NULL, 'cash', 7 FROM supplier""")
def statement_answers(spark, sf_dir):
    """Reports after the date go; one without a date stays."""
    s, key = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    report = lambda day, cash: F.to_json(F.struct(F.lit(day).alias("fiscalDateEnding"), cash.alias("cash"), F.lit("None").alias("debt")))
    undated = F.lit('{"cash": "7"}')
    many = lambda day, *more: F.concat(F.lit("["), F.concat_ws(",", *(report(f"{y}-{day}", (key * y).cast("string")) for y in (2023, 2024, 2025)), *more), F.lit("]"))
    answer = F.concat(F.lit('{"annualReports":'), many("12-31", undated), F.lit(',"quarterlyReports":'), many("03-31"), F.lit("}"))
    return payloads.statement_reports(s.select(key.alias("symbol"), answer.alias("answer")), "answer", "2024-12-31")


@query("""SELECT o_custkey AS customer, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seq, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'K' || o_orderkey AS symbol, o_orderstatus = 'O' AS pending,
    CASE WHEN o_orderstatus <> 'O' THEN '+1.0%' END AS raw, 'Rating: Hold' || chr(10) || o_orderpriority AS decision, CASE WHEN o_orderstatus <> 'O' THEN 'learnt ' || o_orderkey ELSE '' END AS reflection FROM orders""")
def decision_log_text(spark, sf_dir):
    """Logs of a few entries each, written and read as text."""
    o = load(spark, sf_dir, "orders").withColumn("done", F.col("o_orderstatus") != "O")
    head = F.concat(F.lit("["), F.concat_ws(" | ", F.to_date("o_orderdate").cast("string"), F.concat(F.lit("K"), "o_orderkey"), F.lit("Hold"), F.when(F.col("done"), "+1.0% | +0.5% | 5d").otherwise("pending")), F.lit("]"))
    body = F.concat(F.lit("\n\nDECISION:\nRating: Hold\n"), F.col("o_orderpriority"), F.when(F.col("done"), F.concat(F.lit("\n\nREFLECTION:\nlearnt "), "o_orderkey")).otherwise(""))
    entry = F.concat(head, body, F.lit(f"\n\n{files.ENTRY_END}\n\n"))
    logs = o.groupBy(F.col("o_custkey").alias("customer")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "").alias("log"))
    return files.parse_decision_log(logs, "log", ("customer",)).select("customer", F.col("seq").cast("int").alias("seq"), "date", "symbol", "pending", "raw", "decision", "reflection")


def _of(values: list, key: str):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'not_configured' WHEN 4 THEN 'other' WHEN 5 THEN 'other' END AS kind FROM part""")
def notice_kinds(spark, sf_dir):
    given = ["Our rate limit is 25 requests per day with your API key", "This is a PREMIUM endpoint", "standard call frequency", "the apikey is invalid", "higher api call volume", "", None]
    return load(spark, sf_dir, "part").select("p_partkey", text.classify_notice(_of(given, "p_partkey")).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'it’s café A' WHEN 1 THEN '&lt; x… &unknown;' WHEN 2 THEN 'a < b & c' WHEN 3 THEN 'one two' ELSE '' END AS body FROM part""")
def decoded_markup(spark, sf_dir):
    given = ["it&#8217;s <b>caf&eacute;</b> &#x41;", "&amp;lt; &nbsp; x&hellip; &unknown;", "a &lt; b &amp; c", "head <!-- SC_OFF --><p>one</p>\n<p>two</p><!-- SC_ON --> tail", None]
    return load(spark, sf_dir, "part").select("p_partkey", text.strip_markup(_of(given, "p_partkey")).alias("body"))


@query("""SELECT o_orderkey, printf('%+.2f', o_totalprice) AS signed, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE printf('%+.1f%%', CAST(o_orderkey % 200 - 100 AS DOUBLE)) END AS percent, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS whole, CAST(o_orderkey % 101 AS VARCHAR) || '%' AS share,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE printf('%+.1fpp', CAST(o_orderkey % 50 AS DOUBLE)) END AS points, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE printf('%.2f', o_totalprice) END AS shown,
    CASE WHEN o_orderkey >= 1000 THEN CAST(o_orderkey // 1000 AS VARCHAR) || '.0k' ELSE CAST(o_orderkey // 1000 * 1000 AS VARCHAR) END AS human, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def number_formats(spark, sf_dir):
    o, k, price = load(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        "o_orderkey", text.signed_number(price).alias("signed"), text.signed_percent(F.when(k % 9 != 0, (k % 200 - 100) / 100.0)).alias("percent"), text.thousands(price).alias("whole"), text.whole_percent((k % 101) / 100.0).alias("share"),
        text.points((k % 50) / 100.0).alias("points"), text.show(F.when(k % 3 != 0, price), "double").alias("shown"), text.human_count(F.floor(k / 1000) * 1000).alias("human"), text.show(F.col("o_orderdate"), "timestamp_ntz").alias("day"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m%dT') || '0930' AS compact, CAST(o_orderdate AS DATE) + INTERVAL 22 HOUR AS instant, o_orderdate AS plain, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * o_orderkey AS utc,
    TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (o_orderkey + 19800) AS local FROM orders""")
def date_forms(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(
        "o_orderkey", dates.strict_date(F.col("d")).alias("day"), dates.compact_from_text(F.concat("d", F.lit(" 09:30"))).alias("compact"), dates.parsed_instant(F.concat("d", F.lit("T23:30:00+01:30"))).alias("instant"),
        dates.parsed_instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("plain"), dates.from_epoch(F.col("o_orderkey")).alias("utc"), dates.from_epoch_local(F.col("o_orderkey"), "Asia/Kolkata").alias("local"),
    )


@query("""SELECT conv_id, turn, coalesce(CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || chr(10) || 'again' ELSE '' END, '') AS body FROM conversations""")
def message_texts(spark, sf_dir):
    c, kind = load(spark, sf_dir, "conversations"), F.col("turn") % 3
    block = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("text"))
    two = F.concat(F.lit("["), F.to_json(block("reasoning", F.lit("no"))), F.lit(","), F.to_json(block("text", F.col("role"))), F.lit(',"again"]'))
    return c.select("conv_id", "turn", text.content_text(F.when(kind == 0, F.col("role")).when(kind == 1, two).otherwise("[]")).alias("body"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'short' END AS company_name, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_nationkey END AS sector, CAST((CASE WHEN s_suppkey % 3 <> 2 THEN 1 ELSE 0 END) + (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS INT) AS n_fields FROM supplier WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT s_suppkey, NULL, NULL, 0 FROM supplier WHERE s_suppkey % 5 = 0""")
def identity_lookup(spark, sf_dir):
    """Asked for in lower case; every fifth symbol is unknown and has an empty identity."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    symbol = F.concat(F.lit("S"), k.cast("string"))
    profiles = s.where(k % 5 != 0).select(symbol.alias("symbol"), F.when(k % 3 == 0, F.concat(F.lit(" "), "s_name")).when(k % 3 == 1, "None").alias("longName"), F.when(k % 3 == 1, "short").otherwise(" n/a ").alias("shortName"), F.when(k % 2 == 0, F.concat(F.lit("N"), "s_nationkey")).otherwise("NaN").alias("sector"))
    asked = identity.with_identity(s.select("s_suppkey", F.lower(symbol).alias("symbol")), profiles)
    value = lambda name: F.try_element_at("identity", F.lit(name)).alias(name)
    return asked.select("s_suppkey", value("company_name"), value("sector"), F.size("identity").alias("n_fields"))


@query("""SELECT p_partkey, '**Action**: Buy' || chr(10) || chr(10) || '**Reasoning**: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '**Entry Price**: ' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) ELSE '' END || chr(10) || chr(10) || 'FINAL TRANSACTION PROPOSAL: **BUY**' AS proposal,
    '**Overall Sentiment:** **Mixed** (Score: ' || CAST(p_size % 11 AS VARCHAR) || '.0/10)' || chr(10) || '**Confidence:** Low' || chr(10) || chr(10) || p_name AS sentiment FROM part""")
def decision_texts(spark, sf_dir):
    p, size = load(spark, sf_dir, "part"), F.col("p_size")
    proposal = render.trader_proposal(F.lit("Buy"), F.col("p_name"), F.when(size % 2 == 0, size.cast("double")), F.lit(None).cast("double"), F.lit(""))
    sentiment = render.sentiment_report(F.lit("Mixed"), (size % 11).cast("double"), F.lit("low"), F.col("p_name"))
    return p.select("p_partkey", proposal.alias("proposal"), sentiment.alias("sentiment"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'family' ELSE 'none' END AS found, CASE p_partkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'c' ELSE 'a,b,c' END AS ordered, CASE p_partkey % 4 WHEN 0 THEN 189.5::DOUBLE WHEN 3 THEN -2 END AS number FROM part""")
def ordered_lookups(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    names = F.split(_of(["b,zzz,a", "", "c,c", "c,b,a"], "p_partkey"), ",")
    found = text.first_match(_of(["m1", "x-9", "m1x", "?"], "p_partkey"), {"m1": "exact"}, {"^x-": "family"}, "none")
    return p.select("p_partkey", found.alias("found"), F.array_join(text.in_order(names, ["a", "b", "c"]), ",").alias("ordered"), text.optional_number(_of([" 189.5 ", "TBD", "-", "-2"], "p_partkey")).alias("number"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_messages(spark, sf_dir):
    return telemetry.newest(load(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("""SELECT query_no, CAST(row_number() OVER (PARTITION BY query_no ORDER BY doc_id) - 1 AS INT) AS position, doc_id FROM (SELECT 0 AS query_no, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id FROM documents WHERE source IS NOT NULL)""")
def union_in_order(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return news.ordered_union([d.where("lang = 'en'"), d.where("source IS NOT NULL")], ["doc_id"]).select("query_no", "position", "doc_id")


@query(f"""WITH {_STATUS} SELECT run, CAST(a AS BIGINT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) AS completed, 4::BIGINT AS stages FROM r""")
def stage_progress(spark, sf_dir):
    return telemetry.progress(telemetry.stage_status(_reports(spark, sf_dir), ["market", "social", "news", "fundamentals"]))


@query("""WITH s AS (SELECT substr(sha256(upper(event_type) || ':2024-01-15'), 1, 16) AS thread, event_id AS step, event_type FROM events) SELECT thread, max(step) AS step FROM s WHERE event_type <> 'click' GROUP BY thread""")
def checkpoint_steps(spark, sf_dir):
    """The newest step of each thread after one thread's rows were deleted."""
    e = load(spark, sf_dir, "events")
    store = e.select(symbols.thread_key(F.col("event_type"), F.lit("2024-01-15")).alias("thread"), F.col("event_id").alias("step"))
    return checkpoints.latest_step(checkpoints.clear(store, "click", "2024-01-15"))


@query("""SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close FROM orders WHERE o_orderkey % 3 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""")
def csv_answers(spark, sf_dir):
    """Prices as CSV text, some lines broken."""
    o, bad = load(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 == 0
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1"), F.lit("1"), F.lit("1"), F.when(bad, "n/a").otherwise(F.col("o_totalprice").cast("string")), F.lit("5"))
    answers = o.select(F.col("o_custkey").alias("symbol"), F.concat(F.lit("timestamp,open,high,low,close,volume\r\n"), line, F.lit("\r\n")).alias("answer"))
    return payloads.daily_csv(answers, "answer", "1995-01-01", "1997-12-31").select("symbol", "date", "close")


def _engine(spark, sf_dir) -> Engine:
    """The request API over entities made from the tables."""
    d, o = load(spark, sf_dir, "documents"), load(spark, sf_dir, "orders")
    articles = d.select(F.lit("ALL").alias("symbol"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (F.col("doc_id") % 5).alias("query_no"), F.col("doc_id").alias("position"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp_ntz").alias("published"))
    series = o.groupBy(F.lit("GDP").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    sheets = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.lit("balance_sheet").alias("statement"), F.lit("annual").alias("freq"), F.lit("2024-12-31").cast("date").alias("period_end"), F.lit("cash").alias("line_item"), F.col("s_acctbal").alias("value"))
    # Orders by priority as cash flows of quarters, by status as income of years.
    customer = F.concat(F.lit("C"), F.col("o_custkey") % 20).alias("symbol")
    for statement, freq, unit, item in (("cashflow", "quarterly", "quarter", "o_orderpriority"), ("income_statement", "annual", "year", "o_orderstatus")):
        ends = F.last_day(F.add_months(F.date_trunc(unit, "o_orderdate"), 2 if unit == "quarter" else 11)).alias("period_end")
        rows = o.groupBy(customer, ends, F.col(item).alias("line_item")).agg(F.sum("o_totalprice").alias("value"))
        sheets = sheets.unionByName(rows.withColumns({"statement": F.lit(statement), "freq": F.lit(freq)}))
    insiders = o.select(customer, F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("number"))
    listed = load(spark, sf_dir, "part").select(
        F.concat(F.lit("Will there be a "), "p_name", F.lit("?")).alias("question"), F.col("p_partkey").alias("event_no"), F.lit(0).alias("market_no"), F.lit('["Yes", "No"]').alias("outcomes"), F.concat(F.lit('["0.'), (F.col("p_size") + 10).cast("string"), F.lit('", "0.1"]')).alias("outcomePrices"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("volumeNum"), F.when(F.col("p_partkey") % 3 == 0, "2023-01-01T00:00:00Z").otherwise("2025-01-01T00:00:00Z").alias("endDate"), (F.col("p_partkey") % 7 == 0).alias("closed"),
    )
    profiles = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.col("s_name").alias("longName"))
    info = series.select("series", F.lit("Gross domestic product").alias("title"), F.lit("Bil. $").alias("units"), F.lit("Daily").alias("frequency"), F.lit("SA").alias("adjustment")).limit(1)
    return Engine({"bars": event_bars(spark, sf_dir, "user_id"), "news": articles, "series": series, "statements": sheets, "profiles": profiles, "insiders": insiders, "markets": listed, "series_info": info})


@query(f"WITH {USERS} SELECT symbol, date, round_even(open, 2) AS open, round_even(close, 2) AS close, volume FROM users WHERE symbol = '7' AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'")
def request_stock_data(spark, sf_dir):
    return _engine(spark, sf_dir).get_stock_data(" 7 ", "2024-01-02", "2024-01-20").value.select("symbol", "date", "open", "close", "volume")


@query(f"""WITH {USERS}, i AS (SELECT date, avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) AS a, avg(close) OVER (ORDER BY date ROWS 19 PRECEDING) AS b FROM users WHERE symbol = '7' AND date <= DATE '2024-01-20'),
    c AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2024-01-20' - INTERVAL 9 DAY, TIMESTAMP '2024-01-20 00:00:00', INTERVAL 1 DAY) g(d)), l AS (SELECT 'close_50_sma' AS indicator, c.date, i.a AS value, i.date AS d FROM c LEFT JOIN i USING (date) UNION ALL SELECT 'boll', c.date, i.b, i.date FROM c LEFT JOIN i USING (date))
    SELECT indicator, date, round(value, 4) AS value, CASE WHEN d IS NULL THEN 'non_trading' ELSE 'ok' END AS status FROM l UNION ALL SELECT 'magic', NULL, NULL, 'error'""")
def request_indicators(spark, sf_dir):
    return _engine(spark, sf_dir).get_indicators("7", "close_50_sma, MAGIC,boll", "2024-01-20", 9).value.select("indicator", "date", F.round("value", 4).alias("value"), "status")


@query("""WITH f AS (SELECT string_split(text, chr(10))[1] AS title, doc_id AS position, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS TIMESTAMP) AS published FROM documents ORDER BY doc_id LIMIT 20) SELECT * FROM f WHERE published BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-16 00:00:00'""")
def request_news(spark, sf_dir):
    return _engine(spark, sf_dir).get_news("all", "2024-01-03", "2024-01-15").value.select("title", "position", "published")


@query("""WITH n AS (SELECT string_split(text, chr(10))[1] AS title, doc_id % 5 AS query_no, doc_id AS position, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS published FROM documents WHERE string_split(text, chr(10))[1] <> ''),
    u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY title ORDER BY query_no, position) = 1), f AS (SELECT * FROM u ORDER BY query_no, position LIMIT 60)
    SELECT title, query_no, position FROM f WHERE published BETWEEN DATE '2024-01-13' AND DATE '2024-01-21'""")
def request_global_news(spark, sf_dir):
    return _engine(spark, sf_dir).get_global_news("2024-01-20", 7, 60).value.select("title", "query_no", "position")


@query("""WITH n AS (SELECT string_split(text, chr(10))[1] AS title, doc_id % 5 AS query_no, doc_id AS position, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS published FROM documents WHERE string_split(text, chr(10))[1] <> ''),
    u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY title ORDER BY query_no, position) = 1), f AS (SELECT * FROM u ORDER BY query_no, position LIMIT 200)
    SELECT title, query_no, position FROM f WHERE published BETWEEN DATE '2024-01-26' AND DATE '2024-01-27'""")
def request_global_news_one_day(spark, sf_dir):
    """A look-back of no days is the day itself, not the usual look-back."""
    return _engine(spark, sf_dir).get_global_news("2024-01-26", 0, 200).value.select("title", "query_no", "position")


@query("""WITH c AS (SELECT last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS period_end, o_orderpriority AS line_item, sum(o_totalprice) AS value FROM orders WHERE o_custkey % 20 = 7 GROUP BY 1, 2)
    SELECT period_end, line_item, round(value, 2) AS value FROM c WHERE period_end <= DATE '1997-08-15'""")
def request_cashflow(spark, sf_dir):
    return _engine(spark, sf_dir).get_cashflow("c7", "Quarterly", "1997-08-15").value.withColumn("value", F.round("value", 2))


@query("""SELECT last_day(date_trunc('year', o_orderdate) + INTERVAL 11 MONTH) AS period_end, o_orderstatus AS line_item, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_custkey % 20 = 7 GROUP BY 1, 2""")
def request_income_statement(spark, sf_dir):
    """Without a date all periods."""
    return _engine(spark, sf_dir).get_income_statement("C7", "annual").value.withColumn("value", F.round("value", 2))


@query("SELECT 'C3' AS symbol, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS amount, o_orderkey AS number FROM orders WHERE o_custkey % 20 = 3")
def request_insiders(spark, sf_dir):
    return _engine(spark, sf_dir).get_insider_transactions("c3").value


@query("""SELECT 'Will there be a ' || p_name || '?' AS question, CASE WHEN p_size % 5 <> 0 THEN p_retailprice ELSE 0 END AS volume, CAST('0.' || CAST(p_size + 10 AS VARCHAR) AS DOUBLE) AS probability, 'Yes' AS label, p_partkey AS event_no FROM part
    WHERE contains(lower(p_name), 'red') AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 ORDER BY CASE WHEN p_size % 5 <> 0 THEN p_retailprice ELSE 0 END DESC, p_partkey LIMIT 9""")
def request_prediction_markets(spark, sf_dir):
    return _engine(spark, sf_dir).get_prediction_markets("RED", "2024-06-01", 9).value.select("question", "volume", "probability", "label", "event_no")


@query(f"""WITH {USERS}, u AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS k, avg(close) OVER x AS a, avg(close) OVER y AS b FROM users WHERE symbol = '7' AND date <= DATE '2024-01-20' WINDOW x AS (ORDER BY date ROWS 49 PRECEDING), y AS (ORDER BY date ROWS 19 PRECEDING))
    SELECT 'bar' AS section, unnest(['Open', 'High', 'Low', 'Close', 'Volume']) AS indicator, date, round(unnest([open, high, low, close, volume]), 4) AS value, NULL AS error FROM u WHERE k = 1
    UNION ALL SELECT 'indicator', unnest(['close_50_sma', 'boll', 'magic']), date, round(unnest([a, b, NULL]), 4), unnest([NULL, NULL, 'unknown indicator magic']) FROM u WHERE k = 1
    UNION ALL SELECT 'close', 'Close', date, round(close, 4), NULL FROM u WHERE k <= 4""")
def request_snapshot(spark, sf_dir):
    """The bar, the indicators (one of them unknown) and the newest closes."""
    rows = _engine(spark, sf_dir).get_verified_market_snapshot("7", "2024-01-20", 4, ("close_50_sma", "boll", "magic"))
    return rows.select("section", "indicator", "date", F.round("value", 4).alias("value"), "error")


@query(f"""WITH {USERS}, w AS (SELECT symbol, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM users GROUP BY symbol, date_trunc('week', date))
    SELECT symbol, date, round(avg(high) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING), 4) AS value FROM w""")
def indicator_parameters(spark, sf_dir):
    """Of weeks, over three rows, of the high."""
    return indicators.parameterised(event_bars(spark, sf_dir, "user_id"), "sma", "weekly", 3, "high").withColumn("value", F.round("value", 4))


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1), w AS (SELECT * FROM s WHERE date BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30'),
    c AS (SELECT count(*) AS n, arg_min(value, date) AS a, arg_max(value, date) AS b FROM w)
    SELECT date, value, n, b - a AS delta, round(100 * (b - a) / nullif(a, 0), 4) AS pct, 'Gross domestic product' AS title, 'Bil. $' AS units FROM w, c ORDER BY date DESC LIMIT 40""")
def request_macro_change(spark, sf_dir):
    """Forty rows, the change over all of the window, and what the series is."""
    return _engine(spark, sf_dir).get_macro_indicators("GDP", "1998-06-30").value.select("date", "value", "n", "delta", F.round("pct", 4).alias("pct"), "title", "units")


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1) SELECT 'GDP' AS series, date, value FROM s WHERE date BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30' ORDER BY date DESC LIMIT 40""")
def request_macro(spark, sf_dir):
    return _engine(spark, sf_dir).get_macro_indicators("gdp", "1998-06-30").value.select("series", "date", "value")


@query("""SELECT 'Name' AS field, s_name AS value FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'cash', CAST(s_acctbal AS VARCHAR) FROM supplier WHERE s_suppkey = 3""")
def request_fundamentals(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    sheet = engine.get_balance_sheet("s3", "annual", "2025-01-01").value.select(F.col("line_item").alias("field"), F.col("value").cast("string").alias("value"))
    return engine.get_fundamentals("S3").value.select("field", "value").unionByName(sheet)


_TRIES = """t AS (SELECT o_custkey AS key, o_orderkey % 4 AS priority, CASE WHEN o_orderkey % 11 < 2 THEN 'ok' WHEN o_orderkey % 11 < 5 THEN 'no_data' WHEN o_orderkey % 11 < 8 THEN 'rate_limited' WHEN o_orderkey % 11 < 9 THEN 'not_configured' ELSE 'error' END AS status,
    o_totalprice AS value, CAST(o_orderkey AS VARCHAR) AS detail FROM orders WHERE o_custkey % 7 <> 3 OR o_orderkey % 11 BETWEEN 5 AND 7 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) = 1)"""


@query(f"""WITH {_TRIES}, g AS (SELECT key, min(priority) FILTER (status = 'ok') AS a, max(priority) FILTER (status = 'no_data') AS b, min(priority) FILTER (status IN ('error', 'not_configured')) AS c FROM t GROUP BY key)
    SELECT g.key, CASE WHEN a IS NOT NULL THEN 'ok' WHEN b IS NOT NULL THEN 'no_data' WHEN c IS NOT NULL AND g.key % 2 = 0 THEN 'unavailable' ELSE 'error' END AS status, 's' || CAST(a AS VARCHAR) AS source, x.value,
    CASE WHEN a IS NOT NULL THEN NULL WHEN b IS NOT NULL THEN y.detail WHEN c IS NOT NULL THEN z.detail ELSE 'no source could serve it' END AS detail
    FROM g LEFT JOIN t x ON x.key = g.key AND x.priority = a LEFT JOIN t y ON y.key = g.key AND y.priority = b LEFT JOIN t z ON z.key = g.key AND z.priority = c""")
def settled_answers(spark, sf_dir):
    """Orders as tries of four sources for each customer; every second customer's request is an optional one."""
    o = load(spark, sf_dir, "orders").where("o_custkey % 7 <> 3 OR o_orderkey % 11 BETWEEN 5 AND 7")
    first = o.groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).alias("priority")).agg(F.min("o_orderkey").alias("k"), F.min_by("o_totalprice", "o_orderkey").alias("value"))
    kind = F.col("k") % 11
    status = F.when(kind < 2, "ok").when(kind < 5, "no_data").when(kind < 8, "rate_limited").when(kind < 9, "not_configured").otherwise("error")
    tries = first.select("key", "priority", F.concat(F.lit("s"), F.col("priority").cast("string")).alias("source"), status.alias("status"), "value", F.col("k").cast("string").alias("detail"))
    return routing.settled(tries, ["key"], F.col("key") % 2 == 0)


@query("""WITH e AS (SELECT o_orderkey, '[' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' | C' || CAST(o_custkey AS VARCHAR) || ' | Hold | pending]' AS tag, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'P'),
    f AS (SELECT *, CASE WHEN n < 3 THEN 'a' WHEN n < 200 THEN 'b' ELSE 'c' END AS file FROM e)
    SELECT substr(tag, 2, 10) AS date, string_split(tag, ' | ')[2] AS symbol, CAST(o_orderkey AS VARCHAR) AS decision, CAST(row_number() OVER (ORDER BY n) AS BIGINT) AS rank FROM f QUALIFY row_number() OVER (ORDER BY n DESC) <= 50 OR n < 10""")
def decision_log_files(spark, sf_dir):
    """A log in three files, the first of them the smallest: its first and its newest entries by seq."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    work = work_folder(spark, "logs")
    # Places by a window, and each file as one text of its entries.
    n = F.row_number().over(W.orderBy("o_orderkey")) - 1
    tag = F.concat(F.lit("["), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | C"), F.col("o_custkey").cast("string"), F.lit(" | Hold | pending]"))
    entry = F.concat(tag, F.lit("\n\nDECISION:\n"), F.col("o_orderkey").cast("string"), F.lit(f"\n\n{files.ENTRY_END}"))
    rows = o.select(n.alias("n"), entry.alias("entry")).withColumn("file", F.when(F.col("n") < 3, "a").when(F.col("n") < 200, "b").otherwise("c"))
    whole = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n\n").alias("value"))
    whole.repartition("file").write.partitionBy("file").text(f"{work}/log")
    log = files.read_decision_log(spark, f"{work}/log/*/*.txt").withColumn("seq", F.row_number().over(W.orderBy("seq")).cast("long"))
    last = log.agg(F.max("seq")).first()[0] or 0
    return log.where((F.col("seq") <= 10) | (F.col("seq") > last - 50)).select("date", "symbol", "decision", F.col("seq").alias("rank"))


@query(f"""WITH {USERS} SELECT symbol, date, round_even(close, 2) AS close, CASE WHEN CAST(symbol AS BIGINT) = 7 THEN 'tables' ELSE 'vendor' END AS source FROM users WHERE symbol IN ('7', '9') AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'""")
def request_fallback(spark, sf_dir):
    """Two symbols, of which the first source has one; the other comes from the vendor's CSV. A third vendor only sends notices."""
    bars = event_bars(spark, sf_dir, "user_id")
    engine = Engine({"bars": bars.where("symbol = '7'")})
    lines = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")))
    body = F.concat(F.lit("timestamp,open,high,low,close,volume\r\n"), F.array_join(F.array_sort(F.collect_list(lines)), "\r\n"))
    answers = bars.groupBy("symbol").agg(body.alias("body")).withColumns({"method": F.lit("get_stock_data"), "size": F.lit("compact")})
    limited = answers.withColumn("body", F.lit('{"Note": "Our rate limit is 25 requests per day"}'))
    vendor_answers.VendorAnswers(limited, "2024-01-31").register(engine.router, "limited")
    vendor_answers.VendorAnswers(answers, "2024-01-31").register(engine.router, "vendor")
    found = [engine.get_stock_data(s, "2024-01-02", "2024-01-20") for s in ("7", "9")]
    one, two = (a.value.select("symbol", "date", "close").withColumn("source", F.lit(a.source)) for a in found)
    return one.unionByName(two)


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, event_type, value FROM events)
    SELECT event_id, '$.k' AS path, CASE WHEN k % 3 = 0 THEN 'STRING' ELSE 'BIGINT' END AS kind, CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END AS number, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END AS text, CAST(NULL AS BOOLEAN) AS flag FROM e
    UNION ALL SELECT event_id, '$.user.id', 'BIGINT', user_id, NULL, NULL FROM e UNION ALL SELECT event_id, '$.user.name', 'STRING', NULL, event_type, NULL FROM e
    UNION ALL SELECT event_id, '$.tags[0]', 'BOOLEAN', NULL, NULL, k > 50 FROM e UNION ALL SELECT event_id, '$.tags[1]', 'VOID', NULL, NULL, NULL FROM e UNION ALL SELECT event_id, '$.tags[2].deep[0]', 'STRING', NULL, 'x', NULL FROM e""")
def typed_props(spark, sf_dir):
    """Properties of events within objects and lists, one field as a number or as text: all come back with the type they were sent with."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    sent = F.when(k.cast("int") % 3 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    body = F.concat(F.lit('{"k": '), sent, F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit(', "name": "'), F.col("event_type"), F.lit('"}, "tags": ['), (k.cast("int") > 50).cast("string"), F.lit(', null, {"deep": ["x"]}]}'))
    found = typed.leaves(e.select("event_id", body.alias("body")), "body", ("event_id",))
    return found.select("event_id", "path", "kind", typed.number(F.col("value")).alias("number"), typed.text(F.col("value")).alias("text"), typed.flag(F.col("value")).alias("flag"))
