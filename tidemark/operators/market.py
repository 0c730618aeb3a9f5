"""Price bars, returns, return windows, factor panels and control residuals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.core import percent_return, safe_corr

SETTLED = ("complete", "corrected")
#: Fixed value: minutes after the close until a bar counts as settled.
SETTLEMENT_MINUTES = 30
#: Rows of a control regression's history, and complete ones needed.
HISTORY, COMPLETE = 60, 30
WINDOWS = ("gap", "session", "gap_and_session")


def classify_bar(day: Column, fetched: Column, close_sec: Column, values: Sequence[Column], volume: Column, positive: bool = True) -> tuple[Column, Column]:
    """(status, volume flag) of a fetched bar.

    Missing or impossible prices are provider_invalid; a bar fetched before the
    close and its settlement delay is provisional, otherwise complete.  Values that
    may be zero are no prices: ``positive`` is false.
    """
    open_, high, low, close = values
    bad = open_.isNull() | high.isNull() | low.isNull() | close.isNull() | (low <= 0 if positive else F.lit(False)) | (high < low) | ~open_.between(low, high) | ~close.between(low, high)
    settled_at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + close_sec + SETTLEMENT_MINUTES * 60)
    status = F.when(bad, "provider_invalid").when(fetched.cast("timestamp") < settled_at, "provisional").otherwise("complete")
    flag = F.when(volume.isNull(), "missing").when(volume == 0, "zero").otherwise("ok")
    return status, flag


def volume_review(trading: Column, close_sec: Column, volume: Column, early: int = 64_800) -> Column:
    """Why a bar is to be looked at: a day without a session, or a session without volume; an early close has reasons of its own."""
    kind = F.when(close_sec < early, "half").otherwise("full")
    none = F.when(volume.isNull(), "missing_volume").when(volume == 0, "zero_volume")
    return F.when(~trading, "non_trading_day").when(none.isNotNull(), F.concat_ws("_", none, kind))


def resolve_bars(versions: DataFrame, key: str = "date", order: str = "fetched_at") -> DataFrame:
    """The standing bar of each key among its fetched versions.

    Unsettled versions never replace settled ones; among settled ones a
    correction wins and stays; the latest wins otherwise.
    """
    rank = F.when(F.col("bar_status") == "corrected", 3).when(F.col("bar_status") == "complete", 2).when(F.col("bar_status") == "provisional", 1).otherwise(0)
    best = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.struct(rank, F.col(order))).alias("b"))
    return best.select("b.*")


def settled(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("bar_status").isin(*SETTLED)) if "bar_status" in bars.columns else bars


def daily_returns(bars: DataFrame, keys: Sequence[str] = (), close: str = "close") -> DataFrame:
    """``bars`` with daily_return: percent change from the last known close before; NULL first and after a zero."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.col(close), ignorenulls=True).over(w)
    return bars.withColumn("daily_return", F.when((before != 0) & F.col(close).isNotNull(), (F.col(close) / before - 1) * 100))


def next_session(bars: DataFrame) -> DataFrame:
    """Lead on the complete series first; sparse signals are joined afterwards."""
    w = W.orderBy("date")
    out = daily_returns(bars)
    return out.withColumns({"next_close": F.lead("close").over(w), "next_return": F.lead("daily_return").over(w)})


def rolling_mean(series: DataFrame, value: str, n: int = 5, least: int = 3, keys: Sequence[str] = ()) -> Column:
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def rolling_corr(a: str, b: str, n: int = 30, least: int = 10, keys: Sequence[str] = ()) -> Column:
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(1 - n, 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(F.count(F.when(both, 1)).over(w) >= least, safe_corr(a, b, w))


def neighbours(days: DataFrame, bars: DataFrame, day: str = "date") -> DataFrame:
    """As-of join: each day with the last settled bar strictly before it and the first strictly after.

    One union and one window each way; no pair of days is formed.
    """
    b = settled(bars).select(F.col("date").alias("_d"), F.lit(1).alias("_k"), F.struct("date", "close").alias("_bar"))
    q = days.select(F.col(day).alias("_d"), F.lit(0).alias("_k"), F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar")).distinct()
    # days are few whatever the rows behind them, so one window over all of them is bounded
    u = q.unionByName(b)
    back = W.orderBy("_d", "_k").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy(F.desc("_d"), "_k").rowsBetween(W.unboundedPreceding, -1)
    found = u.withColumns({"previous": F.last("_bar", True).over(back), "next": F.last("_bar", True).over(ahead)}).where("_k = 0")
    return found.select(F.col("_d").alias(day), "previous", "next")


def return_windows(events: DataFrame, calendar: DataFrame, bars: DataFrame, session: str = "session", bucket: str = "timing_bucket") -> DataFrame:
    """One row for each event and window: entry and exit dates, raw return, availability, tradability and reason.

    gap: the close of the calendar's session before to the open; session: open to
    close; gap_and_session: close to close.  Events whose time is during the
    session or unknown have the last alone, untradable.
    """
    cal = F.broadcast(calendar.select(F.col("date").alias(session), F.col("prev").alias("_prev"), "is_trading"))
    b = settled(bars).select(F.col("date").alias(session), F.col("open").alias("_o"), F.col("close").alias("_c"))
    p = settled(bars).select(F.col("date").alias("_prev"), F.col("close").alias("_pc"))
    e = events.join(cal, session, "left").join(b, session, "left").join(p, "_prev", "left")
    s, prev, o, c, pc = (F.col(x) for x in (session, "_prev", "_o", "_c", "_pc"))
    no_bar, no_prev = c.isNull(), pc.isNull()
    reason = lambda gap: F.when(F.col("is_trading").isNull() | ~F.col("is_trading"), "not_a_session").when(no_bar, "no_complete_price_bar").when(F.lit(gap) & no_prev, "no_prior_session_bar")
    vague = F.col(bucket).isin("during_session", "unknown")
    rows = [
        ("gap", prev, s, percent_return(pc, o), True),
        ("session", s, s, percent_return(o, c), False),
        ("gap_and_session", prev, s, percent_return(pc, c), True),
    ]
    structs = [
        F.struct(F.lit(n).alias("window_name"), a.alias("entry_date"), z.alias("exit_date"), F.when(reason(g).isNull(), r).alias("raw_return"), reason(g).alias("reason"), (~vague).cast("int").alias("is_tradable"))
        for n, a, z, r, g in rows
    ]
    some = F.when(vague, F.array(structs[2])).otherwise(F.array(*structs))
    keep = [x for x in events.columns]
    return e.withColumn("_w", F.explode(some)).select(*keep, "_w.*").withColumn("is_available", F.col("reason").isNull().cast("int"))


def market_return_series(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Close-to-close return of each session whose calendar predecessor has a bar too."""
    b, p = settled(bars), settled(bars).select(F.col("date").alias("prev"), F.col("close").alias("_pc"))
    return b.join(F.broadcast(calendar.select("date", "prev")), "date").join(p, "prev").select("date", percent_return(F.col("_pc"), F.col("close")).alias("market_return"))


def lagged_panel(factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a date with each symbol's return and its lag, keyed on the symbol's own next date; a fixed list of names, so no pass to find them."""
    r = daily_returns(factors, ["symbol"])
    r = r.withColumn("lagged", F.lag("daily_return").over(W.partitionBy("symbol").orderBy("date")))
    both = F.array(F.struct(F.col("symbol").alias("name"), F.col("daily_return").alias("v")), F.struct(F.concat("symbol", F.lit("_lag1")).alias("name"), F.col("lagged").alias("v")))
    long = r.select("date", F.explode(both).alias("x"))
    wanted = [x for n in names for x in (n, f"{n}_lag1")]
    return long.select("date", "x.*").groupBy("date").pivot("name", wanted).agg(F.first("v"))


def residual_one_control(rows: DataFrame, y: str, x: str, keys: Sequence[str] = (), history: int = HISTORY, complete: int = COMPLETE) -> DataFrame:
    """``rows`` with n_train, fitted and residual of y on x over the previous ``history`` rows; complete pairs alone count."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-history, -1)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(cx).over(w)
    fitted = F.when((n >= complete) & F.col(x).isNotNull(), F.regr_intercept(cy, cx).over(w) + F.regr_slope(cy, cx).over(w) * F.col(x))
    return rows.withColumns({"n_train": n, "fitted": fitted, "residual": F.col(y) - fitted})


def residual_controls(rows: DataFrame, y: str, controls: Sequence[str], history: int = HISTORY, complete: int = COMPLETE, keys: Sequence[str] = ()) -> DataFrame:
    """As residual_one_control for several controls; without any, the residual is y itself and fitted is 0.

    The window keeps means and covariances of the complete rows, not the rows; the
    normal equations of the centred controls are solved by Cholesky's
    decomposition in expressions, a column for each of its entries.  A control
    that the others before it explain, or that does not vary, adds nothing.  A fit
    needs ``complete`` rows and more than there are coefficients.
    """
    if not controls:
        return rows.withColumns({"n_train": F.lit(0).cast("long"), "fitted": F.lit(0.0), "residual": F.col(y)})
    k = range(len(controls))
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-history, -1)
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (y, *controls)])
    now = [F.col(c).cast("double") for c in controls]
    past = [F.when(known, x) for x in (*now, F.col(y).cast("double"))]
    out = rows.withColumns({f"_x{i}": x for i, x in enumerate(past)})
    x = [F.col(f"_x{i}") for i in range(len(past))]
    out = out.withColumns(
        {"n_train": F.count(x[-1]).over(w)}
        | {f"_m{i}": F.avg(v).over(w) for i, v in enumerate(x)}
        | {f"_s{i}_{j}": F.covar_pop(x[i], x[j]).over(w) for i in range(len(x)) for j in k if j <= i}
    )
    s = lambda i, j: F.col(f"_s{i}_{j}")
    low = lambda i, j: F.col(f"_l{i}_{j}")
    minus = lambda first, terms: reduce(lambda p, q: p - q, terms, first)
    # rows of the lower triangle; the last row is that of y, and is what the triangle gives for it
    for j in k:
        rest = minus(s(j, j), [low(j, t) * low(j, t) for t in range(j)])
        out = out.withColumn(f"_l{j}_{j}", F.when(rest > s(j, j) * 1e-12, F.sqrt(rest)))
        below = {f"_l{i}_{j}": F.coalesce(minus(s(i, j), [low(i, t) * low(j, t) for t in range(j)]) / low(j, j), F.lit(0.0)) for i in range(j + 1, len(x))}
        out = out.withColumns(below)
    for j in reversed(k):
        out = out.withColumn(f"_b{j}", F.coalesce(minus(low(len(k), j), [low(t, j) * F.col(f"_b{t}") for t in range(j + 1, len(k))]) / low(j, j), F.lit(0.0)))
    line = reduce(lambda p, q: p + q, [F.col(f"_b{j}") * (now[j] - F.col(f"_m{j}")) for j in k], F.col(f"_m{len(k)}"))
    enough = (F.col("n_train") >= complete) & (F.col("n_train") > len(k) + 1)
    out = out.withColumn("fitted", F.when(enough, line)).withColumn("residual", F.col(y) - F.col("fitted"))
    return out.select(*rows.columns, "n_train", "fitted", "residual")
