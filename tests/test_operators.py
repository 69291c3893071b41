"""Operators against worked cases and plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marlstone import api
from marlstone.errors import NoData, NotConfigured, RateLimited, StaleData
from marlstone.functions import symbols
from marlstone.operators import checkpoints, cleaning, decision_log, identity, indicators, markets, news, rules, statements, telemetry, timeseries
from marlstone.sources import files, routing

D = dt.date


def bars(spark, n=30, symbol="A", start=D(2026, 4, 1)):
    days = [start + dt.timedelta(i) for i in range(n * 2) if (start + dt.timedelta(i)).weekday() < 5][:n]
    rows = [(symbol, d, 99.5 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1e6 + i) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_point_in_time(spark):
    df = bars(spark, 36).unionByName(spark.createDataFrame([("A", D(2026, 6, 1), 999.0, 999.0, 999.0, 999.0, 1.0)], bars(spark).schema))
    assert cleaning.latest(cleaning.as_of(df, "2026-05-16")).first()["date"] == D(2026, 5, 15)
    assert cleaning.last_rows(cleaning.as_of(df, "2026-05-13"), 999).count() == 30
    assert cleaning.as_of(df, "2020-01-01").count() == 0


@pytest.mark.parametrize(("day", "stale"), [("2026-06-10", False), ("2026-06-01", False), ("2026-05-31", True), ("2025-06-11", True)])
def test_staleness(spark, day, stale):
    df = spark.createDataFrame([("A", D.fromisoformat(day))], "symbol string, date date")
    assert cleaning.staleness(df, "2026-06-11").first()["stale"] is stale


def test_date_names(spark):
    for name in ("index", "Datetime", "date"):
        assert cleaning.rename_date(spark.createDataFrame([(1,)], f"{name} int")).columns == ["Date"]


def test_fill(spark):
    df = spark.createDataFrame([("A", D(2026, 1, i), v) for i, v in ((1, None), (2, 5.0), (3, None), (4, 7.0))], "symbol string, date date, open double")
    assert [r["open"] for r in cleaning.fill_gaps(df, ("open",)).orderBy("date").collect()] == [5.0, 5.0, 5.0, 7.0]


def ewm(xs, alpha):
    out, num, den = [], 0.0, 0.0
    for x in xs:
        num, den = num * (1 - alpha) + x, den * (1 - alpha) + 1
        out.append(num / den)
    return out


def test_ewm_over_many_blocks(spark):
    xs = [100 + 20 * math.sin(i / 7) + i % 13 for i in range(1300)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "symbol string, date int, close double")
    for alpha in (2 / 11, 1 / 14, 2 / 201):
        got = [r["e"] for r in indicators.ewm(df, {"e": ("close", alpha)}).orderBy("date").collect()]
        assert max(abs(a - b) for a, b in zip(got, ewm(xs, alpha), strict=True)) < 1e-7


def test_indicator_values(spark):
    got = indicators.with_indicators(bars(spark), indicators.NAMES).orderBy("date").collect()
    assert got[0]["boll_ub"] is None and got[0]["atr"] == pytest.approx(2) and got[0]["rsi"] is None and got[0]["macd"] == 0
    assert got[-1]["rsi"] == 100 and got[-1]["mfi"] == 100 and got[-1]["close_50_sma"] == pytest.approx(114.5)
    assert got[-1]["close_10_ema"] == pytest.approx(ewm([100.0 + i for i in range(30)], 2 / 11)[-1])
    assert got[-1]["boll"] == pytest.approx(119.5) and got[-1]["boll_ub"] == pytest.approx(119.5 + 2 * math.sqrt(35))
    with pytest.raises(ValueError, match="unknown"):
        indicators.with_indicators(bars(spark), ["magic"])
    assert "close_5_sma" in indicators.with_indicators(bars(spark), ["close_5_sma"]).columns


def test_calendar(spark):
    df = bars(spark, 10).withColumn("v", F.when(F.col("date") > "2026-04-01", F.col("close")))
    got = timeseries.calendar_dense(df, "v", "2026-04-06", 5).orderBy("date").collect()
    assert [r["status"] for r in got] == ["warmup", "ok", "ok", "non_trading", "non_trading", "ok"]


def prices(spark, xs, start=D(2026, 1, 5), symbol=None):
    rows = [(start + dt.timedelta(i), float(x)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "date date, close double")
    return df if symbol is None else df.withColumn("symbol", F.lit(symbol))


@pytest.mark.parametrize(("asset", "bench", "want"), [([100, 102, 104, 103, 105, 106], [400, 402, 404, 403, 405, 406], (0.06, 0.045, 5)), ([100, 102, 104, 103, 105, 106], [400, 402, 403], (0.04, 0.0325, 2)), ([100], [400, 401], (None, None, None)), ([], [400, 401], (None, None, None))])
def test_outcomes(spark, asset, bench, want):
    decisions = spark.createDataFrame([("A", D(2026, 1, 5))], "symbol string, date date")
    got = timeseries.holding_outcome(decisions, prices(spark, asset, symbol="A"), prices(spark, bench)).first()
    assert (got["raw"], got["alpha"], got["days"]) == (want if want[0] is None else (pytest.approx(want[0]), pytest.approx(want[1]), want[2]))


def test_series_change(spark):
    df = spark.createDataFrame([("s", D(2025, 6, 7 + i), v) for i, v in enumerate((4.1, 4.3, None, 4.4))], "series string, date date, value double")
    r = timeseries.change_over_window(df).first()
    assert (r["n"], r["last_value"], round(r["delta"], 6), round(r["pct"], 2)) == (3, 4.4, 0.3, 7.32)
    zero = spark.createDataFrame([("s", D(2025, 1, 1 + i), float(i)) for i in range(30)], df.schema)
    assert timeseries.change_over_window(zero).first()["pct"] is None


def test_as_of_join(spark):
    left = spark.createDataFrame([("A", D(2026, 1, d)) for d in (1, 5, 9)], "symbol string, date date")
    right = spark.createDataFrame([("A", D(2026, 1, 5), 1.0), ("A", D(2026, 1, 7), 2.0)], "symbol string, date date, close double")
    assert [r["asof_close"] for r in timeseries.as_of_join(left, right).orderBy("date").collect()] == [None, 1.0, 2.0]


def test_statements(spark):
    wide = spark.createDataFrame([("Cash", 1.0, None, 3.0, "x")], "line_item string, `2024-12-31` double, `2025-12-31` double, `2026-12-31` double, note string").drop("note")
    assert [r["value"] for r in statements.known_periods(statements.unpivot_periods(wide, ("line_item",)), "2025-12-31").collect()] == [1.0]
    reports = spark.createDataFrame([("A", [{"fiscalDateEnding": "2025-03-31", "cash": "5"}, {"cash": "7"}, {"fiscalDateEnding": "2027-01-01", "cash": "1"}])], "symbol string, reports array<map<string,string>>")
    assert [r["value"] for r in statements.report_rows(statements.known_reports(reports, "reports", "2026-01-01"), "reports", ("symbol",)).orderBy("value").collect()] == [5.0, 7.0]


def test_articles(spark):
    schema = "content struct<title:string,summary:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>,pubDate:string>, title string, summary string, publisher string, link string, providerPublishTime long"
    rows = [(("T", None, None, None, ("u",), "2025-05-05T00:00:00Z"), None, None, None, None, None), (None, "F", "s", "P", "l", 1746403200), (None, None, None, None, None, None)]
    got = news.flatten_articles(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("T", "", "Unknown", "u", dt.datetime(2025, 5, 5)), ("F", "s", "P", "l", dt.datetime(2025, 5, 5)), ("No title", "", "Unknown", "", None)]


@pytest.mark.parametrize(("published", "live", "kept"), [("2025-05-05", False, True), ("2025-05-10", False, True), ("2025-05-10 00:00:01", False, False), ("2025-06-01", True, False), (None, False, False), (None, True, True)])
def test_news_window(spark, published, live, kept):
    df = spark.createDataFrame([(published,)], "p string").select(F.col("p").cast("timestamp_ntz").alias("p"))
    assert df.where(news.in_window(F.col("p"), "2025-05-01", "2025-05-09", live)).count() == kept


def test_dedup_and_mix(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("", 0, 0), (None, 0, 2), ("b", 0, 3)], "title string, query_no int, position int")
    assert [tuple(r) for r in news.dedup_top(df, "title", ["query_no", "position"], 5).collect()] == [("a", 0, 1), ("b", 0, 3)]
    assert news.keep_first_known(df, "title", ["query_no", "position"]).where("title IS NULL").count() == 1
    m = spark.createDataFrame([(x,) for x in ["Bullish"] * 5 + ["Bearish"] + [None] * 2], "s string")
    r = news.sentiment_mix(m, "s").first()
    assert (r["bullish"], r["bearish"], r["unlabeled"], r["bullish_pct"], r["bearish_pct"]) == (5, 1, 2, 62, 12)
    assert news.sentiment_mix(m.where("false"), "s").first()["bullish_pct"] == 0


def test_markets(spark):
    schema = "events array<struct<markets:array<struct<question:string,outcomes:string,outcomePrices:string,volumeNum:double,endDate:string,closed:boolean>>>>"
    y = '["Yes","No"]'
    rows = [([([("open", y, '["0.76","0.24"]', 5e6, "2999-01-01T00:00:00Z", False), ("closed", y, '["1","0"]', 9e6, None, True), ("past", y, '["1","0"]', 9e6, "2020-01-01T00:00:00Z", False)],), ([("small", y, '["0.30","0.70"]', None, "2999-01-01", False)],)],)]
    found = markets.unnest_markets(spark.createDataFrame(rows, schema)).where(markets.is_forward_looking("2026-01-01"))
    got = markets.top_markets(found).collect()
    assert [(r["question"], r["probability"], r["volume"]) for r in got] == [("open", 0.76, 5e6), ("small", 0.3, 0.0)]
    assert [r["question"] for r in markets.top_markets(found, 1).collect()] == ["open"]


LOG = "date string, symbol string, rating string, pending boolean, raw double, alpha double, holding int, decision string, reflection string, seq long"


def entry(date, symbol, pending, seq):
    return (date, symbol, "Buy", pending, None if pending else 0.1, None, None, f"d{seq}", None, seq)


def test_decision_log(spark):
    log = spark.createDataFrame([entry("2026-01-01", "A", True, 0), entry("2026-01-01", "B", False, 1)], LOG)
    new = spark.createDataFrame([("2026-01-01", "A", "Buy", "x"), ("2026-01-01", "B", "Buy", "y"), ("2026-01-01", "B", "Buy", "z")], "date string, symbol string, rating string, decision string")
    log = decision_log.append_pending(log, new)
    assert sorted((r["symbol"], r["pending"], r["seq"]) for r in log.collect()) == [("A", True, 0), ("B", False, 1), ("B", True, 2)]
    updates = spark.createDataFrame([("2026-01-01", "A", 0.05, 0.02, 5, "good"), ("2026-01-01", "B", -0.03, -0.01, 5, "bad")], "date string, symbol string, raw double, alpha double, holding int, reflection string")
    done = {r["seq"]: r for r in decision_log.resolve(log, updates).collect()}
    assert not done[0]["pending"] and done[0]["raw"] == 0.05 and done[1]["raw"] == 0.1 and done[2]["reflection"] == "bad"
    many = spark.createDataFrame([entry("2026-01-01", f"S{i}", i == 0, i) for i in range(6)], LOG)
    assert sorted(r["seq"] for r in decision_log.rotate(many, 2).collect()) == [0, 4, 5]
    assert decision_log.rotate(many, None).count() == 6
    assert [(r["kind"], r["seq"]) for r in decision_log.past_context(many, "S5", cross=2).orderBy("kind", "rank").collect()] == [("cross", 4), ("cross", 3), ("same", 5)]
    assert [r["symbol"] for r in decision_log.pending(many).collect()] == ["S0"]


def test_log_text_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("2026-01-01", "A", "Buy", True, None, None, None, "Rating: Buy\nmore", "", 0), ("2026-01-02", "B", "Sell", False, "+5.0%", "+2.0%", "5d", "text", "learnt", 1)], "date string, symbol string, rating string, pending boolean, raw string, alpha string, holding string, decision string, reflection string, seq int")
    text = files.render_decision_log(log).first()["value"]
    (tmp_path / "log.md").write_text(text)
    back = files.read_decision_log(spark, str(tmp_path / "log.md")).orderBy("seq").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in log.orderBy("seq").collect()]


def test_feed(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>one</title><published>2026-01-01T00:00:00+00:00</published><content>&lt;!-- SC_OFF --&gt;&lt;p&gt;it&amp;#39;s&lt;/p&gt;&lt;!-- SC_ON --&gt;</content></entry><entry><title>two</title><published>2026-01-01T00:00:00Z</published></entry></feed>'
    posts = news.forum_posts(files.feed_entries(spark.createDataFrame([("r", xml)], "forum string, xml string"), "xml"))
    got = posts.orderBy("position").collect()
    assert [(r["title"], r["selftext"], r["score"]) for r in got] == [("one", "it's", None), ("two", "", None)] and got[0]["created_utc"] == got[1]["created_utc"] == 1767225600
    assert news.forum_summary(posts).first()["n_posts"] == 2


def test_telemetry(spark):
    snaps = spark.createDataFrame([("r", 10.0, "", None), ("r", 13.0, "x", None), ("r", 18.0, "x", "y")], "run string, at double, market string, social string")
    marks = telemetry.stage_marks(snaps, ["market", "social"])
    assert {r["stage"]: r["wall_s"] for r in telemetry.wall_times(marks, ("run", "stage")).collect()} == {"market": 3.0, "social": 5.0}
    assert telemetry.debate_turns(2) == ["Bull", "Bear", "Bull", "Bear"]
    assert telemetry.execution_plan(["market", "fundamentals"], asset="crypto") == ["market"]
    for bad in (["x"], []):
        with pytest.raises(ValueError):
            telemetry.execution_plan(bad)


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("# note\nDatetime,Close\n2026-01-01,5\n")
    assert files.read_price_csv(spark, str(path)).columns == ["Date", "Close"]
    path.write_text("Datetime,Open\n2026-01-01,5\n")
    with pytest.raises(NoData):
        files.read_price_csv(spark, str(path))
    with pytest.raises(NoData):
        files.write_price_csv(bars(spark).where("false"), str(tmp_path / "b"))
    assert files.read_cache(spark, str(path)) is None and files.read_cache(spark, str(tmp_path / "none")) is None


def test_swapped_tables(spark, tmp_path):
    """Readers of the version before the last swap still find it; older ones are gone."""
    where = str(tmp_path / "t")
    with pytest.raises(NoData):
        files.current(spark, where)
    files.swap_in(bars(spark, 3), where)
    first = files.current(spark, where)
    files.swap_in(bars(spark, 4), where)
    assert (first.count(), files.current(spark, where).count()) == (3, 4)
    files.swap_in(bars(spark, 5), where)
    assert files.current(spark, where).count() == 5 and len(list((tmp_path / "t").glob("v-*"))) == 2


def failing(e):
    def call(*_):
        raise e

    return call


@pytest.mark.parametrize(
    ("calls", "status"),
    [((lambda: 1,), "ok"), ((failing(RateLimited()), lambda: 1), "ok"), ((failing(NoData("A")), lambda: 1), "ok"), ((failing(NoData("A")), failing(KeyError())), "no_data"), ((failing(NotConfigured("k")),), NotConfigured), ((failing(KeyError("x")), failing(NotConfigured("k"))), KeyError), ((failing(RateLimited()),), RuntimeError)],
)
def test_routing(calls, status):
    router = routing.Router(by_category={"core_stock_apis": ",".join(f"s{i}" for i in range(len(calls)))})
    for i, call in enumerate(calls):
        router.register("get_stock_data", f"s{i}", lambda call=call: call())
    if isinstance(status, str):
        assert router.ask("get_stock_data").status == status
    else:
        with pytest.raises(status):
            router.ask("get_stock_data")


def test_routing_settings():
    router = routing.Router(by_category={"news_data": "a"}, by_method={"get_news": "b, zzz"})
    for s in "ab":
        router.register("get_news", s, lambda: 1)
        router.register("get_global_news", s, lambda: 1)
    assert router.chain("get_news") == ["b"] and router.chain("get_global_news") == ["a"]
    router.by_method["get_news"] = "zzz"
    with pytest.raises(ValueError):
        router.chain("get_news")
    router.register("get_macro_indicators", "m", failing(NotConfigured("k")))
    assert router.ask("get_macro_indicators").status == "unavailable"
    router.register("get_macro_indicators", "m", failing(RateLimited()))
    with pytest.raises(RuntimeError):
        router.ask("get_macro_indicators")
    waits = []
    with pytest.raises(RateLimited):
        routing.with_backoff(failing(RateLimited()), sleep=waits.append)
    assert waits == [2, 4, 8] and routing.retry_after("99") == 30 and routing.retry_after(None) == 5
    assert routing.merge_config({"a": {"x": 1}, "b": 1}, {"a": {"y": 2}, "b": 2}) == {"a": {"x": 1, "y": 2}, "b": 2}
    assert routing.coerce_setting("yes", True) is True and routing.coerce_setting("3", 1) == 3


def test_one_more_try():
    waits, calls = [], iter([RateLimited("later", "7"), None])

    def call():
        e = next(calls)
        if e:
            raise e
        return "done"

    assert routing.retry_once(call, waits.append) == "done" and waits == [7]
    with pytest.raises(RateLimited):
        routing.retry_once(failing(RateLimited("later", "90")), waits.append)
    assert waits == [7, 30]


def test_updates_of_one_key(spark):
    log = spark.createDataFrame([entry("2026-01-01", "A", True, 0)], LOG)
    updates = spark.createDataFrame([("2026-01-01", "A", 0.2, 0.1, 5, "x"), ("2026-01-01", "A", 0.1, 0.3, 4, "y")] * 3, "date string, symbol string, raw double, alpha double, holding int, reflection string")
    for n in (1, 5):
        assert decision_log.resolve(log, updates.repartition(n)).first()["reflection"] == "y"


def test_ordered_union(spark):
    a, b = spark.createDataFrame([("x", 2), ("y", 1)], "title string, k int"), spark.createDataFrame([("z", 3)], "title string, k int")
    got = [(r["query_no"], r["position"], r["title"]) for r in news.ordered_union([a, b], ["k"]).orderBy("query_no", "position").collect()]
    assert got == [(0, 0, "y"), (0, 1, "x"), (1, 0, "z")]
    with pytest.raises(ValueError, match="order"):
        news.ordered_union([a, b])


def test_old_rows_are_refused(spark):
    df = spark.createDataFrame([("A", D(2026, 6, 2)), ("A", D(2019, 1, 1))], "symbol string, date date")
    assert cleaning.require_fresh(df, "2026-06-12", "A") is df
    with pytest.raises(StaleData, match="2026-06-02, 11 days"):
        cleaning.require_fresh(df, "2026-06-13", "A")
    with pytest.raises(NoData):
        cleaning.require_rows(df.where("false"), "A")
    assert cleaning.history(df, "2026-06-12").count() == 1 and cleaning.history(df, "2026-06-12", years=9).count() == 2


def test_date_columns(spark):
    made = lambda rows, schema: cleaning.locate_dates(spark.createDataFrame(rows, schema))
    assert made([(1, "x")], "a int, Datetime string") == "Datetime" and made([(1, D(2026, 1, 1))], "a int, b date") == "b"
    assert made([("x", "2026-01-01")], "a string, b string") == "b" and made([(1,)], "a int") is None


def test_identity(spark):
    profiles = spark.createDataFrame([("GC=F", "Gold", None, "n/a", None), ("B", " ", "Bee", "Tech", "X")], "symbol string, longName string, shortName string, sector string, exchange string")
    asked = spark.createDataFrame([("XAUUSD+",), ("b",), ("zzz",)], "symbol string")
    got = {r["symbol"]: r["identity"] for r in identity.with_identity(asked, profiles).collect()}
    assert got == {"XAUUSD+": {"company_name": "Gold"}, "b": {"company_name": "Bee", "sector": "Tech", "exchange": "X"}, "zzz": {}}


def test_checkpoints(spark):
    store = spark.range(6).select(F.when(F.col("id") < 4, symbols.thread_key(F.lit("AAPL"), F.lit("2026-01-15"))).otherwise("other").alias("thread"), F.col("id").alias("step"))
    assert checkpoints.latest_step(store, "aapl", "2026-01-15").first()["step"] == 3 and checkpoints.latest_step(store, "x", "2026-01-15").isEmpty()
    assert checkpoints.clear(store, "AAPL", "2026-01-15").count() == 2 and checkpoints.clear(store).count() == 0


def test_long_logs_are_read_in_many_tasks(spark, tmp_path):
    text = "".join(f"[2026-01-01 | S{i} | Buy | pending]\n\nDECISION:\nfirst {i}\nRating: Buy\n\n{files.ENTRY_END}\n\n" for i in range(5000))
    (tmp_path / "log.md").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        log = files.read_decision_log(spark, str(tmp_path / "log.md"))
        rows, tasks = log.orderBy("seq").collect(), log.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 3 and [r["symbol"] for r in rows] == [f"S{i}" for i in range(5000)] and rows[7]["decision"] == "first 7\nRating: Buy"


def test_requests(spark):
    """The request API over small tables: typed answers, stale rows, unknown indicators, fallback to a second source."""
    tables = {"bars": bars(spark, 36, "GC=F"), "insiders": spark.createDataFrame([("A", "x")], "symbol string, who string"), "series": spark.createDataFrame([("CPIAUCSL", D(2026, 5, 1), 4.1), ("CPIAUCSL", D(2026, 6, 1), None)], "series string, date date, value double")}
    engine = api.Engine(tables)
    assert set(engine.router.sources) == {m for methods in routing.CATEGORIES.values() for m in methods}
    got = engine.get_stock_data("XAUUSD+", "2026-04-01", "2026-04-10")
    assert got.status == "ok" and got.source == "tables" and got.value.count() == 8
    assert engine.get_stock_data("ZZZ", "2026-04-01", "2026-04-10").status == "no_data"
    stale = engine.get_stock_data("GOLD", "2026-04-01", "2027-04-10")
    assert stale.status == "no_data" and "days before" in stale.detail
    rows = engine.get_indicators("XAU", "RSI, magic,close_5_sma", "2026-05-13", 10).value.collect()
    assert sorted({r["indicator"] for r in rows}) == ["close_5_sma", "magic", "rsi"] and [r["status"] for r in rows if r["indicator"] == "magic"] == ["error"]
    assert sum(r["indicator"] == "rsi" and r["status"] == "ok" for r in rows) == 8 and sum(r["status"] == "non_trading" for r in rows) == 6
    whole = engine.get_verified_market_snapshot("XAU", "2026-05-16", 999).collect()
    snap = {r["indicator"]: r for r in whole if r["section"] == "indicator"}
    assert {r["indicator"]: r["value"] for r in whole if r["section"] == "bar"}["Close"] == 132 and sum(r["section"] == "close" for r in whole) == 30
    assert set(snap) == set(indicators.SNAPSHOT) and snap["rsi"]["value"] == 100 and snap["rsi"]["date"] == D(2026, 5, 15)
    assert engine.get_insider_transactions("nobody").value.count() == 0 and engine.get_macro_indicators("cpi", "2026-06-11").value.count() == 1
    assert engine.get_macro_indicators("gdp", "2026-06-11").status == "no_data" and engine.get_news("A", "2026-01-01", "2026-02-01").status == "no_data"
    engine.router.register("get_news", "other", lambda *_: "served")
    assert engine.get_news("A", "2026-01-01", "2026-02-01").source == "other"


def test_snapshot_with_a_bad_name(spark):
    got = {r["indicator"]: (r["value"], r["error"]) for r in indicators.snapshot(bars(spark), ("boll", "nope")).collect()}
    assert got["boll"] == (pytest.approx(119.5), None) and got["nope"][0] is None and "nope" in got["nope"][1]
    # One that lacks its columns is an error of its own, too.
    got = {r["indicator"]: (r["value"], r["error"]) for r in indicators.snapshot(bars(spark).drop("high"), ("boll", "atr")).collect()}
    assert got["boll"] == (pytest.approx(119.5), None) and got["atr"][0] is None and "atr" in got["atr"][1]
    assert not indicators.is_known("mfi", "vendor") and indicators.is_known("vwma", "vendor")


def test_global_news_in_order(spark):
    """The first titles are taken before the window: of twenty dated ones with a limit of five none is left of a late window."""
    rows = [("all", f"t{i}", i, dt.datetime(2026, 1, 1) + dt.timedelta(i)) for i in range(20)]
    engine = api.Engine({"news": spark.createDataFrame(rows, "symbol string, title string, position int, published timestamp_ntz")})
    assert engine.get_global_news("2026-01-17", 4, 5).status == "no_data"
    assert [r["title"] for r in engine.get_global_news("2026-01-17", 4, 15).value.collect()] == ["t12", "t13", "t14"]
    assert engine.get_global_news("2026-01-04", 0, 20).value.count() == 2 and engine.get_global_news("2026-01-04", 3, 0).status == "no_data"


def test_vendor_parameters(spark):
    got = indicators.parameterised(bars(spark, 10), "sma", "weekly", 2, "open").orderBy("date").collect()
    assert [(r["date"], r["value"]) for r in got] == [(D(2026, 4, 3), 99.5), (D(2026, 4, 10), 101.0), (D(2026, 4, 14), 105.0)]
    assert indicators.parameterised(bars(spark, 10), "ema", time_period=3).count() == indicators.parameterised(bars(spark, 10), "boll_ub").count() == 10
    for wrong in ({"interval": "hourly"}, {"series_type": "volume"}, {"function": "magic"}):
        with pytest.raises(ValueError):
            indicators.parameterised(bars(spark, 10), **{"function": "sma", **wrong})


def test_a_log_of_several_files(spark, tmp_path):
    """Files follow one another by name, a small one before a larger one; rotation and context take the newest of the log."""
    entry = lambda day, symbol: f"[{day} | {symbol} | Buy | 1.0% | 0.5% | 5d]\n\nDECISION:\nx\n\n{files.ENTRY_END}\n\n"
    (tmp_path / "2026-01.md").write_text(entry("2026-01-02", "JAN"))
    (tmp_path / "2026-02.md").write_text("".join(entry(f"2026-02-{i:02d}", f"F{i}") for i in range(1, 29)))
    (tmp_path / "2026-03.md").write_text(entry("2026-03-02", "MAR"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        log = files.read_decision_log(spark, str(tmp_path))
        assert [r["symbol"] for r in log.orderBy("seq").collect()] == ["JAN", *(f"F{i}" for i in range(1, 29)), "MAR"]
        assert {r["symbol"] for r in decision_log.rotate(log, 2).collect()} == {"F28", "MAR"}
        assert [r["symbol"] for r in decision_log.past_context(log, "MAR", 1, 2).orderBy("kind", "rank").collect()] == ["F28", "F27", "MAR"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chains_from_tables(spark):
    """A method's setting beats its category's and is exact; names that don't serve drop out; none left is a row of its own; default asks all."""
    methods = spark.createDataFrame([(m, s, k) for m in ("get_news", "get_global_news", "get_stock_data", "get_indicators", "get_macro_indicators") for k, s in enumerate(("a", "b"))], "method string, source string, place int")
    settings = spark.createDataFrame([("news_data", "a"), ("get_news", " b , a,zzz"), ("technical_indicators", "zzz"), ("core_stock_apis", "default")], "scope string, sources string")
    got = sorted(((r["method"], r["priority"], r["source"], r["explicit"]) for r in routing.chains(methods, settings).collect()), key=repr)
    assert got == sorted([("get_news", 0, "b", True), ("get_news", 1, "a", True), ("get_global_news", 0, "a", True), ("get_stock_data", 0, "a", False), ("get_stock_data", 1, "b", False), ("get_indicators", None, None, True), ("get_macro_indicators", 0, "a", False), ("get_macro_indicators", 1, "b", False)], key=repr)


def test_settled_like_the_router(spark):
    """All statuses of three sources, as rows and as calls."""
    import itertools

    def call(status, k):
        def f():
            if status == "ok":
                return f"v{k}"
            raise {"no_data": NoData("x", detail=f"d{k}"), "rate_limited": RateLimited(), "not_configured": NotConfigured(f"e{k}"), "error": KeyError(f"e{k}")}[status]

        return f

    rows, want = [], {}
    for n, (statuses, optional) in enumerate(itertools.product(itertools.product(("ok", "no_data", "rate_limited", "not_configured", "error"), repeat=3), (False, True))):
        router, method = routing.Router(), "get_macro_indicators" if optional else "get_news"
        for k, s in enumerate(statuses):
            router.register(method, f"s{k}", call(s, k))
            rows.append((n, optional, k, f"s{k}", s, f"v{k}" if s == "ok" else None, f"{'d' if s == 'no_data' else 'e'}{k}"))
        try:
            a = router.ask(method)
            want[n] = (a.status, a.source, a.value)
        except Exception:  # noqa: BLE001
            want[n] = ("error", None, None)
    tries = spark.createDataFrame(rows, "key int, optional boolean, priority int, source string, status string, value string, detail string")
    got = {r["key"]: r for r in routing.settled(tries, ["key"], F.col("optional")).collect()}
    assert {k: (r["status"], r["source"], r["value"]) for k, r in got.items()} == want
    last = [r for r in got.values() if r["status"] == "no_data" and r["detail"] == "d2"]
    assert last and all(r["detail"] is None for r in got.values() if r["status"] == "ok")


def test_one_scan_of_each_source(spark, tmp_path):
    bars(spark).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    plan = routing.first_nonempty([("one", df.where("close > 110")), ("two", df)], ["symbol"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange hash") <= 2 and "Join" not in plan


def test_rules_from_tables(spark):
    """The tables of symbols and names as rules: the same as the functions; first in order wins, no nested loop."""
    from marlstone.functions import text
    from marlstone.operators import rules

    names = ["7203.T", "0700.hk", "x.SS", "AAPL", ".T", "T", "", None, "a.NS", "b.ns", "GOLD", "gold"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    table = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(symbols.BENCHMARKS.items())], "rule string, place int, value string")
    got = rules.by_suffix(df, "name", table)
    want = {r["i"]: r["b"] for r in df.select("i", symbols.benchmark_of(F.col("name")).alias("b")).collect()}
    assert {r["i"]: r["value"] for r in got.collect()} == {**want, 7: None}
    assert "NestedLoop" not in rules.by_name(df, "name", table)._jdf.queryExecution().executedPlan().toString()
    notices = spark.createDataFrame([("Our RATE limit", 1), ("an api key and a rate limit", 2), ("premium", 3), ("", 4), ("nothing", 5)], "name string, i int")
    phrases = spark.createDataFrame([(p, i, "limit") for i, p in enumerate(text.LIMIT_PHRASES)] + [(p, 50 + i, "key") for i, p in enumerate(text.KEY_PHRASES)], "rule string, place int, value string")
    assert {r["i"]: r["value"] for r in rules.by_phrase(notices, "name", phrases).collect()} == {1: "limit", 2: "limit", 3: "limit", 4: None, 5: None}
    aliases = spark.createDataFrame([(k, 0, v) for k, v in symbols.ALIASES.items()], "rule string, place int, value string")
    assert {r["i"]: r["value"] for r in rules.by_name(df, "name", aliases).collect()}[11] == "GC=F"


@pytest.mark.parametrize("back", [False, True])
def test_rules_of_equal_numbers(spark, back):
    """The longest rule wins, then the least one, then the least value, in whatever order the rules come."""
    rows = [("ring", 10, "word"), ("ar", 10, "end"), ("ge", 10, "other"), ("ring", 10, "z"), ("bolt", 11, "later")]
    table = spark.createDataFrame(rows[::-1] if back else rows, "rule string, place long, value string").coalesce(1)
    df = spark.createDataFrame([(1, "LARGE ring"), (2, "large bolt"), (3, "string"), (4, "bar")], "i int, name string")
    found = lambda got: {r["i"]: r["value"] for r in got.collect()}
    assert found(rules.by_phrase(df, "name", table)) == {1: "word", 2: "end", 3: "word", 4: "end"}
    assert found(rules.by_suffix(df, "name", table)) == {1: "word", 2: "later", 3: "word", 4: "end"}
    assert found(rules.by_name(df.withColumn("name", F.lit("RING")), "name", table)) == dict.fromkeys((1, 2, 3, 4), "word")
