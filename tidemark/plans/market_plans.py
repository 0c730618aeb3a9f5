"""Queries on bars, returns, windows and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calendar, indicators, market, signals
from tidemark.plans.common import eligible, shown, sql, trading_calendar
from tidemark.sources import driver_tables as d

QUERIES, SQL = {}, {}
NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(text: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return register


@query(sql("bars", "SELECT CAST(date AS VARCHAR) AS date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"))
def ohlc_bars(spark, sf_dir):
    return shown(d.bars(spark, sf_dir))


@query(sql("bars", "SELECT CAST(date AS VARCHAR) AS date, round((close / lag(close) OVER (ORDER BY date) - 1) * 100, 6) AS daily_return FROM bars"))
def daily_returns(spark, sf_dir):
    return shown(market.daily_returns(d.bars(spark, sf_dir)).select("date", "daily_return"))


@query(sql("bars", "WITH r AS (SELECT date, close, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS r FROM bars) SELECT CAST(date AS VARCHAR) AS date, round(lead(close) OVER (ORDER BY date), 6) AS next_close, round(lead(r) OVER (ORDER BY date), 6) AS next_return FROM r"))
def next_session_returns(spark, sf_dir):
    return shown(market.next_session(d.bars(spark, sf_dir)).select("date", "next_close", "next_return"))


SIGNAL = "s AS (SELECT signal_date AS date, avg(score) AS simple_mean, count(*) AS n FROM eligible GROUP BY 1), r AS (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS daily_return FROM bars), x AS (SELECT *, lead(daily_return) OVER (ORDER BY date) AS next_return FROM r)"


def _signal(spark, sf_dir):
    return eligible(spark, sf_dir).groupBy(F.col("signal_date").alias("date")).agg(F.avg("score").alias("simple_mean"), F.count("*").alias("n"))


@query(sql("eligible bars", f"WITH {SIGNAL} SELECT CAST(x.date AS VARCHAR) AS date, round(simple_mean, 6) AS simple_mean, round(daily_return, 6) AS daily_return, round(next_return, 6) AS next_return FROM x JOIN s ON s.date = x.date WHERE n >= 3"))
def signal_return_join(spark, sf_dir):
    r = market.next_session(d.bars(spark, sf_dir)).select("date", "daily_return", "next_return")
    return shown(r.join(_signal(spark, sf_dir).where("n >= 3"), "date").select("date", "simple_mean", "daily_return", "next_return"))


@query(sql("eligible bars", f"WITH {SIGNAL} SELECT CAST(s.date AS VARCHAR) AS date, round(simple_mean, 6) AS simple_mean, round(next_return, 6) AS next_return FROM s LEFT JOIN x ON s.date = x.date"))
def signal_price_left_align(spark, sf_dir):
    r = market.next_session(d.bars(spark, sf_dir)).select("date", "next_return")
    return shown(_signal(spark, sf_dir).join(r, "date", "left").select("date", "simple_mean", "next_return"))


@query(sql("long_bars", "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(close) OVER w >= 3 THEN round(avg(close) OVER w, 4) END AS mean_5 FROM long_bars WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def rolling_mean_5(spark, sf_dir):
    b = d.long_bars(spark, sf_dir)
    return shown(b.select("date", market.rolling_mean(b, "close").alias("mean_5")), 4)


@query(sql("long_bars", "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(*) OVER w >= 10 THEN round(corr(close, volume) OVER w, 6) END AS corr_30 FROM long_bars WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"))
def rolling_corr(spark, sf_dir):
    b = d.long_bars(spark, sf_dir)
    return shown(b.select("date", market.rolling_corr("close", "volume").alias("corr_30")))


PANEL = """p AS (SELECT date, symbol, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS r FROM factors), q AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY date) AS l FROM p)"""


@query(sql("factors", f"WITH {PANEL} SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(f"""round(max(CASE WHEN symbol = '{n}' THEN r END), 6) AS "{n}", round(max(CASE WHEN symbol = '{n}' THEN l END), 6) AS "{n}_lag1" """ for n in NAMES) + " FROM q GROUP BY 1"))
def lagged_factor_panel(spark, sf_dir):
    return shown(market.lagged_panel(d.factors(spark, sf_dir), NAMES))


def _market_and_factor(spark, sf_dir):
    y = market.daily_returns(d.long_bars(spark, sf_dir)).select("date", F.col("daily_return").alias("y"))
    return y.join(market.lagged_panel(d.factors(spark, sf_dir), NAMES), "date", "left")


@query(sql("long_bars factors", f"""WITH {PANEL}, y AS (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS y FROM long_bars),
j AS (SELECT y.date, y, l AS x FROM y LEFT JOIN q ON q.date = y.date AND q.symbol = '1-URGENT'),
k AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS cx, CASE WHEN x IS NOT NULL THEN y END AS cy FROM j),
f AS (SELECT date, y, x, count(cx) OVER w AS n_train, regr_slope(cy, cx) OVER w AS b, regr_intercept(cy, cx) OVER w AS a FROM k WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT CAST(date AS VARCHAR) AS date, n_train, CASE WHEN n_train >= 30 THEN round(a + b * x, 5) END AS fitted, CASE WHEN n_train >= 30 THEN round(y - (a + b * x), 5) END AS residual FROM f"""))
def prior_ols_residual_one_control(spark, sf_dir):
    rows = _market_and_factor(spark, sf_dir).withColumn("x", F.col("`1-URGENT_lag1`"))
    return shown(market.residual_one_control(rows, "y", "x").select("date", "n_train", "fitted", "residual"), 5)


@query("")
def multi_control_residuals(spark, sf_dir):
    rows = _market_and_factor(spark, sf_dir).select("date", "y", F.col("`1-URGENT_lag1`").alias("a"), F.col("`2-HIGH_lag1`").alias("b"), F.col("`5-LOW_lag1`").alias("c"))
    return shown(market.residual_controls(rows, "y", ["a", "b", "c"]).select("date", "n_train", "fitted", "residual"))


@query(sql("assigned bars", """
WITH e AS (SELECT event_ref, signal_date AS session, timing_bucket, count(*) AS n FROM assigned WHERE event_ref IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT e.*, c.prev, b.open AS o, b.close AS c, p.close AS pc FROM e LEFT JOIN calendar c ON c.date = e.session LEFT JOIN bars b ON b.date = e.session LEFT JOIN bars p ON p.date = c.prev),
w AS (
  SELECT event_ref, session, timing_bucket, n, 'gap' AS window_name, prev AS entry_date, (o / pc - 1) * 100 AS r, true AS g, c IS NULL AS nb, pc IS NULL AS np FROM j WHERE timing_bucket NOT IN ('during_session', 'unknown')
  UNION ALL SELECT event_ref, session, timing_bucket, n, 'session', session, (c / o - 1) * 100, false, c IS NULL, pc IS NULL FROM j WHERE timing_bucket NOT IN ('during_session', 'unknown')
  UNION ALL SELECT event_ref, session, timing_bucket, n, 'gap_and_session', prev, (c / pc - 1) * 100, true, c IS NULL, pc IS NULL FROM j),
z AS (SELECT *, CASE WHEN nb THEN 'no_complete_price_bar' WHEN g AND np THEN 'no_prior_session_bar' END AS reason FROM w)
SELECT event_ref, CAST(session AS VARCHAR) AS session, timing_bucket, n, window_name, CAST(entry_date AS VARCHAR) AS entry_date, CAST(session AS VARCHAR) AS exit_date, CASE WHEN reason IS NULL THEN round(r, 6) END AS raw_return, reason,
       CAST(CASE WHEN timing_bucket IN ('during_session', 'unknown') THEN 0 ELSE 1 END AS BIGINT) AS is_tradable, CAST(CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS BIGINT) AS is_available FROM z"""))
def return_windows(spark, sf_dir):
    cal = trading_calendar(spark)
    e = calendar.assign_sessions(d.headlines(spark, sf_dir), cal).where("event_ref IS NOT NULL").groupBy("event_ref", F.col("signal_date").alias("session"), "timing_bucket").agg(F.count("*").alias("n"))
    return shown(market.return_windows(e, cal, d.bars(spark, sf_dir)))


@query(sql("calendar bars", "SELECT CAST(b.date AS VARCHAR) AS date, round((b.close / p.close - 1) * 100, 6) AS market_return FROM bars b JOIN calendar c ON c.date = b.date JOIN bars p ON p.date = c.prev"))
def market_return_series(spark, sf_dir):
    return shown(market.market_return_series(trading_calendar(spark), d.bars(spark, sf_dir)))


@query(sql("long_bars", """WITH q AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT CAST(q.date AS VARCHAR) AS date, (SELECT CAST(max(b.date) AS VARCHAR) FROM long_bars b WHERE b.date < q.date) AS previous_date, (SELECT CAST(min(b.date) AS VARCHAR) FROM long_bars b WHERE b.date > q.date) AS next_date FROM q"""))
def asof_prior_bar(spark, sf_dir):
    days = d.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return shown(market.neighbours(days, d.long_bars(spark, sf_dir)).select("date", F.col("previous.date").alias("previous_date"), F.col("next.date").alias("next_date")))


@query(sql("calendar long_bars", "SELECT CAST(date AS VARCHAR) AS date FROM calendar WHERE is_trading AND date BETWEEN (SELECT min(date) FROM long_bars) AND (SELECT max(date) FROM long_bars) AND date NOT IN (SELECT date FROM long_bars WHERE volume >= 5)"))
def calendar_gaps(spark, sf_dir):
    b = d.long_bars(spark, sf_dir)
    span, cal = b.agg(F.min("date").alias("a"), F.max("date").alias("z")), trading_calendar(spark)
    inside = cal.join(F.broadcast(span), F.col("date").between(F.col("a"), F.col("z"))).where("is_trading")
    return shown(inside.join(b.where("volume >= 5"), "date", "left_anti").select("date"))


@query(sql("bars", """
WITH v AS (SELECT date, close, k, CASE WHEN k = 2 AND day(date) % 7 = 0 THEN 'corrected' WHEN k = 1 THEN 'complete' WHEN k = 2 THEN 'provisional' ELSE 'provider_invalid' END AS bar_status FROM bars, (SELECT unnest([0, 1, 2]) AS k) ks)
SELECT CAST(date AS VARCHAR) AS date, bar_status, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE bar_status WHEN 'corrected' THEN 3 WHEN 'complete' THEN 2 WHEN 'provisional' THEN 1 ELSE 0 END DESC, k DESC) AS i FROM v) x WHERE i = 1"""))
def bar_status_lattice(spark, sf_dir):
    k = F.col("k")
    status = F.when((k == 2) & (F.dayofmonth("date") % 7 == 0), "corrected").when(k == 1, "complete").when(k == 2, "provisional").otherwise("provider_invalid")
    v = d.bars(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("bar_status", status)
    return shown(market.resolve_bars(v, "date", "k").select("date", "bar_status", "k"))


@query(sql("bars long_bars", "SELECT CAST(max(b.date) AS VARCHAR) AS newest, datediff('day', max(b.date), DATE '2024-02-02') AS age_days, CASE WHEN datediff('day', max(b.date), DATE '2024-02-02') <= 5 THEN 'degraded' ELSE 'failed' END AS fallback FROM bars b"))
def market_data_freshness(spark, sf_dir):
    newest = d.bars(spark, sf_dir).agg(F.max("date").alias("newest"))
    age = F.datediff(F.lit("2024-02-02").cast("date"), "newest")
    return shown(newest.select("newest", age.alias("age_days"), F.when(age <= 5, "degraded").otherwise("failed").alias("fallback")))


@query(sql("long_bars", "SELECT CAST(date AS VARCHAR) AS date, round(close - lag(close) OVER (ORDER BY date), 4) AS change FROM long_bars"))
def series_differences(spark, sf_dir):
    from pyspark.sql import Window as W

    return shown(d.long_bars(spark, sf_dir).select("date", (F.col("close") - F.lag("close").over(W.orderBy("date"))).alias("change")), 4)
