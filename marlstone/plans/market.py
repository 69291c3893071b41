"""Queries over bars: cleaning, indicators, calendars, returns."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cleaning, indicators, scan, timeseries
from ..sources import vendor
from ..sources.indicator_table import IndicatorTable
from ..sources.routing import first_nonempty
from ..sources.tables import average_bars, event_bars, line_bars, line_ticks, load
from ..sources.work import saved, work_folder
from ..streaming import outcomes, runs
from .registry import query

AS_OF = "2024-01-20"


def _bars(symbol: str) -> str:
    return f"""SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""


BARS = f"bars AS ({_bars('event_type')})"
USERS = f"users AS ({_bars('user_id')})"
_KEY = "(l_orderkey, l_linenumber, l_extendedprice, l_quantity)"
LINES = f"""lines AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, {_KEY}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {_KEY}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2)"""


def _r(*columns: str, places: int = 4):
    return [F.round(c, places).alias(c) for c in columns]


@query(f"WITH {BARS} SELECT symbol, date, round_even(open, 2) AS open, round_even(high, 2) AS high, round_even(low, 2) AS low, round_even(close, 2) AS close, volume FROM bars")
def bars_daily(spark, sf_dir):
    return cleaning.round_prices(event_bars(spark, sf_dir))


@query(f"WITH {BARS} SELECT symbol, date, close, volume FROM bars WHERE date <= DATE '{AS_OF}'")
def point_in_time_bars(spark, sf_dir):
    return cleaning.as_of(event_bars(spark, sf_dir), AS_OF).select("symbol", "date", "close", "volume")


@query(f"WITH {USERS} SELECT symbol, date, close FROM users WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def range_scan(spark, sf_dir):
    return cleaning.between(event_bars(spark, sf_dir, "user_id"), "2024-01-05", "2024-01-12").select("symbol", "date", "close")


@query(f"WITH {USERS} SELECT symbol, date, close FROM users WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def vendor_range_scan(spark, sf_dir):
    """The same rows from a vendor's answers, a text for each symbol and month; the bounds are pushed into the source."""
    work = work_folder(spark, "answers")
    vendor.record(event_bars(spark, sf_dir, "user_id"), work)
    vendor.use_vendor(spark)
    return cleaning.between(spark.read.format("vendor_bars").option("path", work).load(), "2024-01-05", "2024-01-12").select("symbol", "date", "close")


@query("""WITH raw AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS d, CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(value AS VARCHAR) END AS c,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS v, event_id FROM events)
    SELECT event_id, TRY_CAST(d AS DATE) AS date, round(TRY_CAST(c AS DOUBLE), 4) AS close, TRY_CAST(v AS DOUBLE) AS volume FROM raw WHERE TRY_CAST(d AS DATE) IS NOT NULL AND TRY_CAST(c AS DOUBLE) IS NOT NULL""")
def coerce_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.to_date("ts").cast("string")).alias("index"),
        F.when(F.col("event_id") % 7 == 0, "-").otherwise(F.col("value").cast("string")).alias("close"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("volume"),
    )
    out = cleaning.coerce(cleaning.rename_date(raw, "date"), numbers=("volume",))
    return out.select("event_id", "date", *_r("close"), "volume")


@query(f"""WITH {LINES} SELECT symbol, date, round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), 4) AS close_50_sma,
    round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), 4) AS close_200_sma, round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), 4) AS volume_5_sma FROM lines""")
def sma_windows(spark, sf_dir):
    names = ["close_50_sma", "close_200_sma", "volume_5_sma"]
    return indicators.with_indicators(line_bars(spark, sf_dir), names).select("symbol", "date", *_r(*names))


@query(f"""WITH {LINES}, w AS (SELECT symbol, date, avg(close) OVER x AS m, stddev_samp(close) OVER x AS s FROM lines WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
    SELECT symbol, date, round(m, 4) AS boll, round(m + 2 * s, 4) AS boll_ub, round(m - 2 * s, 4) AS boll_lb FROM w""")
def bollinger(spark, sf_dir):
    return indicators.bollinger(line_bars(spark, sf_dir)).select("symbol", "date", *_r("boll", "boll_ub", "boll_lb"))


@query(f"""WITH {LINES} SELECT symbol, date, round(sum((high + low + close) / 3 * volume) OVER x / sum(volume) OVER x, 4) AS vwma FROM lines
    WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)""")
def vwma(spark, sf_dir):
    df = line_bars(spark, sf_dir)
    return df.withColumn("vwma", indicators.vwma()).select("symbol", "date", *_r("vwma"))


@query(f"""WITH {LINES}, a AS (SELECT *, (high + low + close) / 3 AS tp FROM lines), b AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY date) AS p FROM a),
    c AS (SELECT symbol, date, sum(CASE WHEN tp > p THEN tp * volume ELSE 0 END) OVER x AS u, sum(CASE WHEN tp < p THEN tp * volume ELSE 0 END) OVER x AS d FROM b
    WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)) SELECT symbol, date, round(100 * u / nullif(u + d, 0), 4) AS mfi FROM c""")
def mfi(spark, sf_dir):
    return indicators.mfi(line_bars(spark, sf_dir)).select("symbol", "date", *_r("mfi"))


def _ewm_sql(source: str, value: str, alpha: str, name: str, rows: int = 500) -> str:
    """Weighted self-join over the newest rows; further back nothing is left of the weights."""
    q = f"(1 - {alpha})"
    return f"""{name} AS (SELECT a.symbol, a.n, sum(b.{value} * power({q}, a.n - b.n)) / ((1 - power({q}, any_value(a.n))) / {alpha}) AS v
        FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.n BETWEEN a.n - {rows} AND a.n GROUP BY a.symbol, a.n)"""


_NUMBERED = f"{LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM lines)"


@query(f"WITH {_NUMBERED}, {_ewm_sql('s', 'close', '(2.0 / 11)', 'e')} SELECT s.symbol, s.date, round(e.v, 4) AS close_10_ema FROM s JOIN e USING (symbol, n)")
def ema_10(spark, sf_dir):
    return indicators.ema(line_bars(spark, sf_dir), 10).select("symbol", "date", *_r("close_10_ema"))


@query(f"""WITH {_NUMBERED}, {_ewm_sql('s', 'close', '(2.0 / 13)', 'f')}, {_ewm_sql('s', 'close', '(2.0 / 27)', 'g')}, m AS (SELECT f.symbol, f.n, f.v - g.v AS macd FROM f JOIN g USING (symbol, n)),
    {_ewm_sql('m', 'macd', '(2.0 / 10)', 'h')} SELECT s.symbol, s.date, round(m.macd, 4) AS macd, round(h.v, 4) AS macds, round(m.macd - h.v, 4) AS macdh FROM s JOIN m USING (symbol, n) JOIN h USING (symbol, n)""")
def macd_family(spark, sf_dir):
    return indicators.macd(line_bars(spark, sf_dir)).select("symbol", "date", *_r("macd", "macds", "macdh"))


@query(f"""WITH {_NUMBERED}, d AS (SELECT symbol, n, date, greatest(coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY n), 0), 0) AS gain,
    greatest(-coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY n), 0), 0) AS loss FROM s), {_ewm_sql('d', 'gain', '(1.0 / 14)', 'u')}, {_ewm_sql('d', 'loss', '(1.0 / 14)', 'v')}
    SELECT d.symbol, d.date, round(100 * u.v / nullif(u.v + v.v, 0), 4) AS rsi FROM d JOIN u USING (symbol, n) JOIN v USING (symbol, n)""")
def rsi_14(spark, sf_dir):
    return indicators.rsi(line_bars(spark, sf_dir)).select("symbol", "date", *_r("rsi"))


@query(f"""WITH {_NUMBERED}, p AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY n), close) AS prev FROM s),
    t AS (SELECT symbol, n, date, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM p), {_ewm_sql('t', 'tr', '(1.0 / 14)', 'e')}
    SELECT t.symbol, t.date, round(e.v, 4) AS atr FROM t JOIN e USING (symbol, n)""")
def atr_14(spark, sf_dir):
    return indicators.atr(line_bars(spark, sf_dir)).select("symbol", "date", *_r("atr"))


_EVENTS_N = f"{BARS}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars WHERE date <= DATE '{AS_OF}')"


@query(f"""WITH {_EVENTS_N}, p AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY n), 0) AS c, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY n), close) AS prev FROM s),
    d AS (SELECT symbol, n, greatest(c, 0) AS gain, greatest(-c, 0) AS loss, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM p),
    {_ewm_sql('s', 'close', '(2.0 / 11)', 'e')}, {_ewm_sql('s', 'close', '(2.0 / 13)', 'f')}, {_ewm_sql('s', 'close', '(2.0 / 27)', 'g')}, m AS (SELECT f.symbol, f.n, f.v - g.v AS macd FROM f JOIN g USING (symbol, n)), {_ewm_sql('m', 'macd', '(2.0 / 10)', 'h')},
    {_ewm_sql('d', 'gain', '(1.0 / 14)', 'u')}, {_ewm_sql('d', 'loss', '(1.0 / 14)', 'v')}, {_ewm_sql('d', 'tr', '(1.0 / 14)', 'a')},
    w AS (SELECT symbol, n, date, close, avg(close) OVER x AS s50, avg(close) OVER z AS s200, avg(close) OVER y AS mid, stddev_samp(close) OVER y AS d FROM s
    WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), z AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING))
    SELECT symbol, date, close, round(s50, 4) AS close_50_sma, round(s200, 4) AS close_200_sma, round(e.v, 4) AS close_10_ema, round(macd, 4) AS macd, round(h.v, 4) AS macds, round(macd - h.v, 4) AS macdh, round(100 * u.v / nullif(u.v + v.v, 0), 4) AS rsi,
    round(mid, 4) AS boll, round(mid + 2 * d, 4) AS boll_ub, round(mid - 2 * d, 4) AS boll_lb, round(a.v, 4) AS atr FROM w JOIN e USING (symbol, n) JOIN m USING (symbol, n) JOIN h USING (symbol, n) JOIN u USING (symbol, n) JOIN v USING (symbol, n) JOIN a USING (symbol, n)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
def verified_snapshot(spark, sf_dir):
    """All eleven indicators of the snapshot at the newest row of each symbol."""
    names = list(indicators.SNAPSHOT)
    bars = cleaning.as_of(event_bars(spark, sf_dir), AS_OF)
    return cleaning.latest(indicators.with_indicators(bars, names).select("symbol", "date", "close", *names)).select("symbol", "date", "close", *_r(*names))


@query(f"WITH {BARS} SELECT symbol, date, close FROM bars WHERE date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30")
def recent_closes(spark, sf_dir):
    return cleaning.last_rows(cleaning.as_of(event_bars(spark, sf_dir), AS_OF).select("symbol", "date", "close"), 999)


@query(f"WITH {BARS} SELECT symbol, date, close FROM bars WHERE date = DATE '{AS_OF}'")
def point_lookup(spark, sf_dir):
    return event_bars(spark, sf_dir).where(F.col("date") == F.lit(AS_OF).cast("date")).select("symbol", "date", "close")


@query(f"""WITH {USERS}, i AS (SELECT symbol, date, CASE WHEN row_number() OVER x > 1 THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) END AS value FROM users WHERE date <= DATE '{AS_OF}'
    WINDOW x AS (PARTITION BY symbol ORDER BY date)), k AS (SELECT DISTINCT symbol FROM users WHERE date <= DATE '{AS_OF}'),
    c AS (SELECT symbol, CAST(d AS DATE) AS date FROM k, generate_series(DATE '{AS_OF}' - INTERVAL 30 DAY, TIMESTAMP '{AS_OF} 00:00:00', INTERVAL 1 DAY) g(d))
    SELECT c.symbol, c.date, round(i.value, 4) AS value, CASE WHEN i.symbol IS NULL THEN 'non_trading' WHEN i.value IS NULL THEN 'warmup' ELSE 'ok' END AS status FROM c LEFT JOIN i USING (symbol, date)""")
def indicator_calendar_dense(spark, sf_dir):
    bars = cleaning.as_of(event_bars(spark, sf_dir, "user_id"), AS_OF)
    place = F.row_number().over(W.partitionBy("symbol").orderBy("date"))
    values = bars.withColumn("value", F.when(place > 1, indicators.sma("close", 5)))
    return timeseries.calendar_dense(values, "value", AS_OF, 30).withColumn("value", F.round("value", 4))


@query(f"""WITH {USERS}, h AS (SELECT symbol, date, close, CASE WHEN CAST(volume AS INT) % 3 = 0 THEN NULL ELSE open END AS open FROM users WHERE date <= DATE '{AS_OF}')
    SELECT symbol, date, close, coalesce(last_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS open FROM h""")
def gap_fill(spark, sf_dir):
    bars = cleaning.as_of(event_bars(spark, sf_dir, "user_id"), AS_OF)
    holes = bars.select("symbol", "date", "close", F.when(F.col("volume").cast("int") % 3 != 0, F.col("open")).alias("open"))
    return cleaning.fill_gaps(holes, ("open",))


@query(f"""WITH {USERS} SELECT symbol, max(date) AS last_date, CAST(DATE '2024-02-09' - max(date) AS INT) AS days_old, DATE '2024-02-09' - max(date) > 10 AS stale FROM users GROUP BY symbol""")
def staleness_flags(spark, sf_dir):
    return cleaning.staleness(event_bars(spark, sf_dir, "user_id"), "2024-02-09")


@query(f"""WITH {BARS} SELECT symbol, date, close, round((lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) - close) / nullif(close, 0), 6) AS fwd_return FROM bars""")
def forward_return(spark, sf_dir):
    return timeseries.forward_return(event_bars(spark, sf_dir), 5).select("symbol", "date", "close", F.round("fwd_return", 6).alias("fwd_return"))


EXCESS_SQL = f"""WITH {BARS}, bench AS (SELECT date, avg(close) AS close FROM bars GROUP BY date), k AS (SELECT symbol, date AS d FROM bars),
    a AS (SELECT k.symbol, k.d, b.close, row_number() OVER (PARTITION BY k.symbol, k.d ORDER BY b.date) - 1 AS i, count(*) OVER (PARTITION BY k.symbol, k.d) AS n FROM k JOIN bars b ON b.symbol = k.symbol AND b.date BETWEEN k.d AND k.d + 11),
    c AS (SELECT k.d, b.close, row_number() OVER (PARTITION BY k.d ORDER BY b.date) - 1 AS i, count(*) OVER (PARTITION BY k.d) AS n FROM (SELECT DISTINCT d FROM k) k JOIN bench b ON b.date BETWEEN k.d AND k.d + 11),
    t AS (SELECT k.symbol, k.d, least(5, (SELECT max(n) FROM a WHERE a.symbol = k.symbol AND a.d = k.d) - 1, (SELECT max(n) FROM c WHERE c.d = k.d) - 1) AS h FROM k),
    u AS (SELECT t.symbol, t.d, CASE WHEN h >= 1 THEN h END AS h FROM t)
    SELECT u.symbol, u.d AS date, CAST(h AS INT) AS days, round((a1.close - a0.close) / a0.close, 6) AS raw, round((a1.close - a0.close) / a0.close - (c1.close - c0.close) / c0.close, 6) AS alpha
    FROM u LEFT JOIN a a0 ON a0.symbol = u.symbol AND a0.d = u.d AND a0.i = 0 LEFT JOIN a a1 ON a1.symbol = u.symbol AND a1.d = u.d AND a1.i = h
    LEFT JOIN c c0 ON c0.d = u.d AND c0.i = 0 LEFT JOIN c c1 ON c1.d = u.d AND c1.i = h"""


@query(EXCESS_SQL)
def excess_return(spark, sf_dir):
    bars = saved(event_bars(spark, sf_dir), "bars")
    out = timeseries.holding_outcome(bars.select("symbol", "date"), bars, average_bars(bars), rows=5)
    return out.select("symbol", "date", F.col("days").cast("int").alias("days"), *_r("raw", "alpha", places=6))


@query(EXCESS_SQL)
def excess_return_stream(spark, sf_dir):
    """The same rows from a stream: a decision for every bar, pending until its outcome is due. A last clock row lets all windows end."""
    work = work_folder(spark, "outcomes")
    bars = event_bars(spark, sf_dir)
    rows = outcomes.outcome_rows(bars.select("symbol", "date"), bars, average_bars(bars))
    clock = rows.groupBy("symbol").agg(F.lit(outcomes.CLOCK).alias("kind"), F.date_add(F.max("date"), 40).alias("date"), F.lit(None).cast("double").alias("close"))
    rows.unionByName(clock).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(outcomes.INPUT).parquet(f"{work}/in")
    with runs.rocksdb(spark, 8):
        running = runs.run_to_table(outcomes.resolved(stream), f"{work}/out", f"{work}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(outcomes.RESOLVED).parquet(f"{work}/out").select("symbol", "date", "days", *_r("raw", "alpha", places=6))


@query(f"""WITH {USERS}, {BARS}, q AS (SELECT symbol, date FROM users), b AS (SELECT symbol, date, close FROM users WHERE CAST(volume AS INT) % 2 = 0)
    SELECT q.symbol, q.date, b.date AS asof_date, b.close AS asof_close FROM q ASOF LEFT JOIN b ON q.symbol = b.symbol AND q.date >= b.date""")
def as_of_lookup(spark, sf_dir):
    users = event_bars(spark, sf_dir, "user_id")
    right = users.where(F.col("volume").cast("int") % 2 == 0).select("symbol", "date", "close")
    return timeseries.as_of_join(users.select("symbol", "date"), right)


@query(f"""WITH {USERS}, one AS (SELECT symbol, date, close, 'primary' AS source, 0 AS p FROM users WHERE CAST(symbol AS BIGINT) % 3 = 0 AND date <= DATE '2024-01-10'),
    two AS (SELECT symbol, date, close, 'backup' AS source, 1 AS p FROM users), u AS (SELECT * FROM one UNION ALL SELECT * FROM two)
    SELECT symbol, date, close, source FROM u WHERE p = (SELECT min(p) FROM u v WHERE v.symbol = u.symbol)""")
def first_nonempty_source(spark, sf_dir):
    users = event_bars(spark, sf_dir, "user_id").select("symbol", "date", "close")
    n = F.col("symbol").cast("bigint")
    one = cleaning.as_of(users.where(n % 3 == 0), "2024-01-10")
    return first_nonempty([("primary", one), ("backup", users)], ["symbol"]).select("symbol", "date", "close", "source")


@query(f"""WITH {LINES}, {'w AS (SELECT symbol, date, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS a, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS b FROM lines)'}
    SELECT symbol, date, 'close_50_sma' AS indicator, round(a, 4) AS value FROM w UNION ALL SELECT symbol, date, 'boll', round(b, 4) FROM w""")
def indicator_long(spark, sf_dir):
    names = indicators.parse_names(" close_50_sma, BOLL ,")
    return indicators.long_form(indicators.with_indicators(line_bars(spark, sf_dir), names), names).withColumn("value", F.round("value", 4))


#: Line items as one long series; a part is small, so that small tables are cut, too.
TICK_ROWS = 1 << 11
TICKS = """ticks AS MATERIALIZED (SELECT 'L' AS symbol, l_orderkey * 10 + l_linenumber AS tick, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity * (1 - l_discount)) AS low, min(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 2),
    s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tick) AS n, lag(close) OVER (ORDER BY tick) AS prev FROM ticks)"""


def _tick_ewm_sql(source: str, value: str, alpha: str, name: str, rows: int = 520) -> str:
    """The newest rows by equal places; further back nothing is left of the weights."""
    return f"""{name} AS (SELECT a.n, sum(b.{value} * power(1 - {alpha}, k)) / ((1 - power(1 - {alpha}, a.n)) / {alpha}) AS v FROM {source} a CROSS JOIN range({rows}) r(k) JOIN {source} b ON b.n = a.n - k GROUP BY a.n)"""


def _ticks(spark, sf_dir):
    return scan.cut(saved(line_ticks(spark, sf_dir), "ticks"), order="tick", rows=TICK_ROWS)


@query(f"WITH {TICKS}, {_tick_ewm_sql('s', 'close', '(2.0 / 11)', 'e')} SELECT tick, round(e.v, 4) AS close_10_ema FROM s JOIN e USING (n)")
def tick_ema(spark, sf_dir):
    return indicators.ema(_ticks(spark, sf_dir), 10, order="tick", over=scan).select("tick", *_r("close_10_ema"))


@query(f"""WITH {TICKS}, d AS MATERIALIZED (SELECT n, tick, greatest(coalesce(close - prev, 0), 0) AS gain, greatest(coalesce(prev - close, 0), 0) AS loss FROM s), {_tick_ewm_sql('d', 'gain', '(1.0 / 14)', 'u')}, {_tick_ewm_sql('d', 'loss', '(1.0 / 14)', 'v')}
    SELECT tick, round(100 * u.v / nullif(u.v + v.v, 0), 4) AS rsi FROM d JOIN u USING (n) JOIN v USING (n)""")
def tick_rsi(spark, sf_dir):
    return indicators.rsi(_ticks(spark, sf_dir), order="tick", over=scan).select("tick", *_r("rsi"))


@query(f"""WITH {TICKS}, t AS MATERIALIZED (SELECT n, tick, greatest(high - low, abs(high - coalesce(prev, close)), abs(low - coalesce(prev, close))) AS tr FROM s), {_tick_ewm_sql('t', 'tr', '(1.0 / 14)', 'e')}
    SELECT tick, round(e.v, 4) AS atr FROM t JOIN e USING (n)""")
def tick_atr(spark, sf_dir):
    return indicators.atr(_ticks(spark, sf_dir), order="tick", over=scan).select("tick", *_r("atr"))


@query(f"""WITH {TICKS}, h AS (SELECT tick, CASE WHEN tick % 3 <> 0 AND tick > 500 AND tick NOT BETWEEN 9000 AND 60000 THEN close END AS close FROM ticks)
    SELECT tick, coalesce(last_value(close IGNORE NULLS) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM h""")
def tick_gap_fill(spark, sf_dir):
    """Holes everywhere, at the start and over several parts."""
    here = (F.col("tick") % 3 != 0) & (F.col("tick") > 500) & ~F.col("tick").between(9000, 60000)
    return scan.fill_gaps(_ticks(spark, sf_dir).withColumn("close", F.when(here, F.col("close"))), ("close",), order="tick").select("tick", "close")


@query(f"""WITH {TICKS}, r AS (SELECT tick, close FROM ticks WHERE tick % 97 = 0) SELECT t.tick, r.tick AS asof_tick, r.close AS asof_close FROM ticks t ASOF LEFT JOIN r ON t.tick >= r.tick""")
def tick_as_of(spark, sf_dir):
    ticks = saved(line_ticks(spark, sf_dir), "ticks")
    right = ticks.where(F.col("tick") % 97 == 0).select("symbol", "tick", "close")
    return scan.as_of_join(ticks.select("symbol", "tick"), right, date="tick", rows=TICK_ROWS).select("tick", "asof_tick", "asof_close")


@query(f"""WITH {USERS}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS c FROM users), d AS (SELECT *, greatest(c, 0) AS gain, greatest(-c, 0) AS loss FROM s),
    {_ewm_sql('s', 'close', '(2.0 / 11)', 'e')}, {_ewm_sql('d', 'gain', '(1.0 / 14)', 'u')}, {_ewm_sql('d', 'loss', '(1.0 / 14)', 'v')}
    SELECT s.symbol, s.date, round(avg(close) OVER (PARTITION BY s.symbol ORDER BY s.date ROWS 49 PRECEDING), 6) AS close_50_sma, round(e.v, 6) AS close_10_ema, round(100 * u.v / nullif(u.v + v.v, 0), 6) AS rsi FROM s JOIN e USING (symbol, n) JOIN u USING (symbol, n) JOIN v USING (symbol, n)""")
def indicator_table_days(spark, sf_dir):
    """Indicators kept up to date: the bars to the twentieth, then a wrong bar of the day after, then that one as it is with all later days."""
    bars = event_bars(spark, sf_dir, "user_id")
    table = IndicatorTable(spark, work_folder(spark, "indicators"))
    table.update(bars.where("date <= DATE '2024-01-20'"))
    table.update(bars.where("date = DATE '2024-01-21'").withColumn("close", F.col("close") + 1))
    table.update(bars.where("date >= DATE '2024-01-21'"))
    return table.read().select("symbol", "date", *_r("close_50_sma", "close_10_ema", "rsi", places=6))
