"""Vendor answers and reports."""

import datetime as dt
import json

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.sources import payloads, reports


def answer(spark, value, symbol="A"):
    return spark.createDataFrame([(symbol, json.dumps(value)), (symbol, "oops"), (symbol, None)], "symbol string, a string").withColumn("series", F.col("symbol"))


def test_articles(spark):
    got = payloads.articles(answer(spark, [{"content": {"title": "N", "pubDate": "2025-05-05T00:00:00Z", "provider": {"displayName": "P"}}}, {"title": "F", "providerPublishTime": 0}]), "a").collect()
    assert [(r["title"], r["publisher"], r["published"]) for r in got] == [("N", "P", dt.datetime(2025, 5, 5)), ("F", "Unknown", dt.datetime(1970, 1, 1))]
    feed = payloads.feed_articles(answer(spark, {"feed": [{"title": "x", "time_published": "20250505T101500"}]}), "a", ("symbol",)).collect()
    assert [(r["symbol"], r["published"]) for r in feed] == [("A", dt.datetime(2025, 5, 5, 10, 15))]


def test_macro(spark):
    obs = {"observations": [{"date": "2025-06-07", "value": "4.1"}, {"date": "2025-06-08", "value": "."}]}
    assert [tuple(r) for r in payloads.macro_observations(answer(spark, obs), "a").collect()] == [("A", dt.date(2025, 6, 7), 4.1)]
    meta = {"seriess": [{"id": "CPI", "title": "t", "units": "Index", "frequency": "M"}]}
    assert payloads.macro_series(answer(spark, meta), "a").first()["units"] == "Index"


def test_social_and_markets(spark):
    msg = {"messages": [{"user": {"username": "u"}, "entities": {"sentiment": {"basic": "Bullish"}}, "body": "a\nb" + "x" * 300}, {"body": None}]}
    got = payloads.social_stream(answer(spark, msg), "a").collect()
    assert (got[0]["username"], got[0]["sentiment"], len(got[0]["body"])) == ("u", "Bullish", 281) and (got[1]["username"], got[1]["sentiment"]) == ("?", None)
    posts = payloads.forum_search(answer(spark, {"data": {"children": [{"data": {"title": "t", "score": 0}}]}}), "a").collect()
    assert (posts[0]["score"], posts[0]["num_comments"]) == (0, None)
    assert payloads.market_search(answer(spark, {"events": [{"markets": [{"question": "q"}]}, {}]}), "a").count() == 1


def test_statements(spark):
    a = {"annualReports": [{"fiscalDateEnding": "2024-12-31", "cash": "5"}, {"fiscalDateEnding": "2027-12-31", "cash": "6"}], "quarterlyReports": [{"fiscalDateEnding": "2025-03-31", "cash": "None"}]}
    assert [tuple(r) for r in payloads.statement_reports(answer(spark, a), "a", "2026-01-01").collect()] == [("A", "annual", dt.date(2024, 12, 31), "cash", 5.0)]
    assert [tuple(r) for r in payloads.profile(answer(spark, {"longName": "Apple", "beta": 1.2}), "a").orderBy("field").collect()] == [("A", "Beta", "1.2"), ("A", "Name", "Apple")]
    assert payloads.insider_rows(answer(spark, {"data": [{"x": "1"}]}), "a").first()["fields"] == {"x": "1"}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert reports.csv_text(df, {"rows": 2}, ["a"]) == "# rows: 2\na,b\n1,x\n2,\n"
    assert reports.markdown_table(df, ["a"], 1).endswith("| 1 | x |\n\n_(1 of 2 rows)_\n")
    assert len(reports.report_tree({"one": {"p": "text", "q": " "}, "two": {"r": None}}, str(tmp_path))) == 2
    reports.append_log(str(tmp_path / "log"), "a\nb")
    assert (tmp_path / "log").read_text() == "a b\n"


def test_lookups(spark):
    df = spark.createDataFrame([("m1", ["b", "zzz", "a"]), ("x-9", []), ("?", None)], "m string, n array<string>")
    got = df.select(text.first_match(F.col("m"), {"m1": "exact"}, {"^x-": "family"}, "none"), text.in_order(F.col("n"), ["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [("exact", ["a", "b"]), ("family", []), ("none", None if got[2][1] is None else [])]


def test_a_vendor_behind_the_tables(spark):
    """Answers in the vendor's shapes, by its length of series; notices are errors of their kind, and the chain goes on."""
    from marlstone import api
    from marlstone.sources.vendor_answers import VendorAnswers

    csv = "timestamp,open,high,low,close,volume\n2026-05-05,1,2,0.5,1.5,10\n2026-05-06,1,2,0.5,1.255,10\nbroken\n"
    rows = [
        ("get_stock_data", "A", "compact", csv), ("get_stock_data", "A", "full", csv.replace("1.5", "9.5")), ("get_stock_data", "KEY", "compact", '{"Information": "the apikey is invalid"}'), ("get_stock_data", "BAD", "compact", '{"Error Message": "no such symbol"}'),
        ("get_fundamentals", "A", None, '{"longName": "Apple"}'), ("get_news", "A", None, '{"feed": [{"title": "x", "time_published": "20260505T101500"}]}'), ("get_insider_transactions", "A", None, '{"data": [{"x": "1"}]}'),
        ("get_cashflow", "A", None, '{"annualReports": [{"fiscalDateEnding": "2024-12-31", "cash": "5"}, {"fiscalDateEnding": "2027-12-31", "cash": "6"}]}'),
    ]
    engine = api.Engine({})
    VendorAnswers(spark.createDataFrame(rows, "method string, symbol string, size string, body string"), "2026-05-10").register(engine.router, "vendor")
    got = engine.get_stock_data("a", "2026-05-01", "2026-05-08")
    assert got.source == "vendor" and got.value.orderBy("date").first()["close"] == 1.5 and got.value.count() == 2
    assert engine.get_stock_data("A", "2025-01-01", "2026-05-08").value.orderBy("date").first()["close"] == 9.5
    assert engine.get_stock_data("A", "2026-05-01", "2026-06-30").status == "no_data" and engine.get_stock_data("BAD", "2026-05-01", "2026-05-08").status == "no_data"
    # The tables have no data either, and that is what counts; the key is asked for where there is no other source.
    assert engine.get_stock_data("KEY", "2026-05-01", "2026-05-08").status == "no_data" and engine.get_stock_data("none", "2026-05-01", "2026-05-08").status == "no_data"
    assert engine.get_fundamentals("A").value.first()["value"] == "Apple" and engine.get_news("A", "2026-05-01", "2026-05-05").value.count() == 1
    assert engine.get_insider_transactions("A").value.first()["fields"] == {"x": "1"}
    assert [tuple(r) for r in engine.get_cashflow("A", "annual", "2026-01-01").value.collect()] == [(dt.date(2024, 12, 31), "cash", 5.0)]


def test_output_size():
    assert payloads.output_size("2026-02-01", "2026-05-11") == "compact" and payloads.output_size("2026-01-31", "2026-05-11") == "full"


def test_files_and_headings(spark, tmp_path):
    from marlstone.sources import files

    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    files.write_json(df, str(tmp_path / "j"))
    (tmp_path / "one.json").write_text('[{"a": 1,\n "b": "x"}, {"a": 2}]')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "one.json"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert spark.read.schema("a int, b string").json(str(tmp_path / "j")).count() == 2
    reports.save_csv(df, str(tmp_path / "x.csv"), {"n": 2}, ["a"])
    assert (tmp_path / "x.csv").read_text() == "# n: 2\na,b\n1,x\n2,\n" and reports.heading("T", df) == "## T\n\nTotal records: 2\n"


def test_sentiment_of_the_first_messages(spark):
    from marlstone.operators import news

    df = spark.createDataFrame([("a", i, "Bullish" if i < 3 else "Bearish") for i in range(6)] + [("b", 0, None)], "s string, i int, label string")
    got = {r["s"]: (r["bullish"], r["bearish"], r["total"], r["bullish_pct"]) for r in news.sentiment_mix(df, "label", ("s",), 4, ["i"]).collect()}
    assert got == {"a": (3, 1, 4, 75), "b": (0, 0, 1, 0)}
    assert news.sentiment_mix(df, "label", (), 2, ["s", "i"]).first()["bullish_pct"] == 100


def test_values_with_their_types(spark):
    from marlstone.sources import typed

    rows = [("A", '{"data": [{"shares": 5, "price": 1.5, "who": "x", "sold": true}, {"shares": "n/a", "at": {"day": null}}]}'), ("B", '[{"shares": 12345678901}]'), ("C", "[]"), ("D", "oops"), ("E", None)]
    df = spark.createDataFrame(rows, "symbol string, a string")
    got = {(r["symbol"], r["position"], r["field"]): (r["kind"], r["number"], r["text"]) for r in typed.insider_fields(df, "a").collect()}
    assert got == {
        ("A", 0, "shares"): ("BIGINT", 5.0, None), ("A", 0, "price"): ("DECIMAL", 1.5, None), ("A", 0, "who"): ("STRING", None, "x"), ("A", 0, "sold"): ("BOOLEAN", None, None),
        ("A", 1, "shares"): ("STRING", None, "n/a"), ("A", 1, "at.day"): ("VOID", None, None), ("B", 0, "shares"): ("BIGINT", 12345678901.0, None),
    }
    assert [(r["path"], r["kind"]) for r in typed.leaves(df.where("symbol = 'C'"), "a").collect()] == [("$", "ARRAY")]
    assert typed.merged_schema(spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": 2.5}',)], "a string"), "a").first()["schema"] == "OBJECT<a: VARIANT, b: DECIMAL(2,1)>"
