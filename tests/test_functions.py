"""Column functions against worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates, macro, render, symbols, text


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x"))).collect()]


def test_symbols(spark):
    given = ["XAUUSD+", "spx500", "EURUSD", "BTCUSD", "BTC-USDT", "ABCDEF", "", None, " aapl ", "GC=F", "XUSDT"]
    assert values(spark, symbols.normalize_symbol, given) == ["GC=F", "^GSPC", "EURUSD=X", "BTC-USD", "BTC-USD", "ABCDEF", "", None, "AAPL", "GC=F", "XUSDT"]
    assert values(spark, symbols.asset_class, ["btcusd", "AAPL", "ETH-BTC", None]) == ["crypto", "stock", "crypto", "stock"]
    assert values(spark, symbols.benchmark_of, ["7203.T", "7203.t", "0700.HK", "600519.SS", "BRK.B", "FAKE.XX"]) == ["^N225", "^N225", "^HSI", "000001.SS", "SPY", "SPY"]
    assert values(spark, lambda c: symbols.benchmark_of(c, override="QQQ"), ["7203.T"]) == ["QQQ"]
    assert values(spark, symbols.is_path_safe, ["AAPL", "../x", "..", "GC=F+", "A" * 33, "", None]) == [True, False, False, True, False, False, False]
    assert values(spark, symbols.is_ticker_input, ["", " ^GSPC ", "a+b", "A" * 33]) == [True, True, False, False]


def test_macro(spark):
    assert values(spark, macro.series_id, ["cpi", "Fed Funds Rate", "10y-treasury", "dgs30", "bank of japan rate", "X" * 31, " "]) == ["CPIAUCSL", "FEDFUNDS", "DGS10", "DGS30", None, None, None]
    assert values(spark, macro.observed, ["4.1", ".", "", "x", None]) == [4.1, None, None, None, None]


def test_ratings(spark):
    given = ["Rating: Buy\nx", "**Rating**: **Sell**", "We hold.\nRating - Underweight", "nothing", "We Overweight this", "rating: maybe\nsell*", ""]
    assert values(spark, text.parse_rating, given) == ["Buy", "Sell", "Underweight", "Hold", "Overweight", "Sell", "Hold"]


def test_text(spark):
    given = ["<p>a&amp;b</p> <b> c</b>", "x<!-- SC_OFF --><p>it&#39;s</p><!-- SC_ON -->y", None, ""]
    assert values(spark, text.strip_markup, given) == ["a&b c", "it's", "", ""]
    assert values(spark, lambda c: text.truncate(c, 3), ["abc", "abcd", None]) == ["abc", "abc…", None]
    assert values(spark, text.clean_identity, [" Apple ", "  ", "None", "n/a", None]) == ["Apple", None, None, None, None]
    assert values(spark, text.optional_number, ["189.5", "TBD", "-", "x"]) == [189.5, None, None, None]
    assert values(spark, text.json_strings, ['["a", "b"]', "oops", None]) == [["a", "b"], [], []]
    assert values(spark, lambda c: text.first_probability(text.json_strings(c)), ['["0.76"]', '["x"]', "[]"]) == [0.76, None, None]
    assert values(spark, text.human_count, [999, 1200], "long") == ["999", "1.2k"]
    assert values(spark, lambda c: text.show(c, "double"), [1.005, None], "double")[1] == "N/A"
    notices = ["Thank you; our rate limit is 25 requests per day with your API key", "the api key is invalid", "hello", None]
    assert values(spark, text.classify_notice, notices) == ["rate_limited", "not_configured", "other", None]
    assert values(spark, text.classify_notice, ["a Premium endpoint", "higher api call volume", "25 requests per minute", "call frequency"]) == ["rate_limited", "other", "other", "rate_limited"]


def test_dates(spark):
    assert values(spark, dates.parsed_date, ["2025-01-31", "nope", None]) == [dt.date(2025, 1, 31), None, None]
    assert values(spark, dates.parsed_instant, ["2025-05-05T10:00:00Z", "2025-05-05T12:00:00+02:00", "x"])[:2] == [dt.datetime(2025, 5, 5, 10)] * 2
    days = [dt.date(2025, 5, 9), dt.date(2025, 5, 10), dt.date(2025, 5, 11), dt.date(2025, 5, 12)]
    assert values(spark, dates.next_weekday, days, "date") == [days[0], days[3], days[3], days[3]]
    assert values(spark, dates.from_epoch, [0], "long") == [dt.datetime(1970, 1, 1)]


@pytest.mark.parametrize(("name", "same"), [("AAPL", True), ("aapl", True), ("MSFT", False)])
def test_thread_key(spark, name, same):
    a, b = values(spark, lambda c: symbols.thread_key(c, F.lit("2026-01-15")), ["AAPL", name])
    assert (a == b) == same and len(a) == 16


def test_references(spark):
    given = ["it&#8217;s caf&eacute; &#x41;", "&amp;lt; &nbsp;x&hellip;&unknown;", "no &amp no;", "plain"]
    assert values(spark, text.strip_markup, given) == ["it’s café A", "&lt; x…&unknown;", "no & no;", "plain"]


def test_references_that_end(spark):
    given = ["by%%% the&amp</title> x&amp;amp", "&ampx; &amp;lt; caf&eacute; &eacute", "&#65;&#65 &#x41;&", "no &lt no&gt;"]
    assert values(spark, lambda c: text.strip_markup(c, ended=True), given) == ["by%%% the&amp x&amp", "&ampx; &lt; café &eacute", "A&#65 A&", "no &lt no>"]


def test_formats(spark):
    assert values(spark, text.signed_percent, [0.042, -0.1, None], "double") == ["+4.2%", "-10.0%", None]
    assert values(spark, text.signed_number, [0.3, -2.0], "double") == ["+0.30", "-2.00"]
    assert values(spark, text.thousands, [1234567.5, 12.4], "double") == ["1,234,568", "12"]
    assert values(spark, text.whole_percent, [0.76, 0.125], "double") == ["76%", "12%"]
    assert values(spark, text.points, [-0.045, 0.0, None], "double") == ["-4.5pp", None, None]
    assert values(spark, text.human_count, [1250, 1350], "long") == ["1.2k", "1.4k"]


def test_contents(spark):
    given = ["plain", '[{"type":"reasoning","text":"no"},{"type":"text","text":"one"},"two",{"type":"text","text":""}]', "[broken", None]
    assert values(spark, text.content_text, given) == ["plain", "one\ntwo", "[broken", None]


def test_strict_dates(spark):
    assert values(spark, dates.strict_date, ["2025-01-31", "2025-1-5", None]) == [dt.date(2025, 1, 31), dt.date(2025, 1, 5), None]
    for f, bad in ((dates.strict_date, "31.1.2025"), (dates.compact_from_text, "soon")):
        with pytest.raises(Exception, match="date"):
            values(spark, f, [bad])
    assert values(spark, dates.compact_from_text, ["2025-05-05", "2025-05-05 10:07", "20250505T1010", None]) == ["20250505T0000", "20250505T1007", "20250505T1010", None]
    assert values(spark, lambda c: dates.from_epoch_local(c, "America/New_York"), [1746403200], "long") == [dt.datetime(2025, 5, 4, 20)]


def test_rendered_decisions(spark):
    df = spark.createDataFrame([("Buy", "why", 189.5, None, "", 7.25, "HIGH")], "a string, r string, e double, s double, z string, x double, c string")
    c = F.col
    got = df.select(render.research_plan(c("a"), c("r"), c("r")), render.trader_proposal(c("a"), c("r"), c("e"), c("s"), c("z")), render.portfolio_decision(c("a"), c("r"), c("r"), c("s"), c("z")), render.sentiment_report(c("a"), c("x"), c("c"), c("r"))).first()
    assert got[0] == "**Recommendation**: Buy\n\n**Rationale**: why\n\n**Strategic Actions**: why"
    assert got[1] == "**Action**: Buy\n\n**Reasoning**: why\n\n**Entry Price**: 189.5\n\nFINAL TRANSACTION PROPOSAL: **BUY**"
    assert got[2] == "**Rating**: Buy\n\n**Executive Summary**: why\n\n**Investment Thesis**: why"
    assert got[3].split("\n") == ["**Overall Sentiment:** **Buy** (Score: 7.3/10)", "**Confidence:** High", "", "why"]
    with pytest.raises(Exception, match="outside"):
        df.select(render.in_range(c("e"), 0, 10)).collect()


def test_references_like_the_standard_library(spark):
    """Every name with and without its semicolon and with letters behind it, numbers at all bounds, and random mixtures."""
    import html
    import html.entities
    import random

    r = random.Random(8)
    names = list(html.entities.html5)
    texts = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}" for n in names] + [f"&{n.rstrip(';')}zz; &" for n in names]
    for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**12]:
        texts += [f"&#{n};x", f"&#{n} ", f"&#x{n:x};", f"&#X{n:X}g", f"&#000{n};"]
    pieces = ["&", "amp", "AMP", ";", "#", "x", "65", "lt", "notit", "not", "é", " ", "\n", "<", "copy", "&&", "nbsp;", "#x41", "frac12", "x" * 40]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {x["i"]: x["u"] for x in df.select("i", text.unescape(F.col("t")).alias("u")).collect()}
    assert got[-1] is None
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert wrong == []


def test_markup_needs_no_python(spark):
    plan = spark.createDataFrame([("a&amp;b",)], "t string").select(text.strip_markup(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
