"""Trading calendar and the assignment of publication times to sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Session bounds in seconds of the day, 10:00:00 and 18:10:00.
OPEN_SEC, CLOSE_SEC = 36_000, 65_400
SESSION_RULE = "session-v1"


def build_calendar(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = (), half_days: Mapping[str, int] | None = None) -> DataFrame:
    """One row a day: date, is_trading, close_sec, next_on_or_after, next_after, prev.

    A calendar is a few thousand rows whatever the data, so its windows over one
    partition and its broadcast are bounded.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS date")
    holiday = F.col("date").cast("string").isin(*holidays) if holidays else F.lit(False)
    close = F.lit(CLOSE_SEC)
    for day, sec in (half_days or {}).items():
        close = F.when(F.col("date") == F.lit(day).cast("date"), sec).otherwise(close)
    days = days.withColumns({"is_trading": (F.weekday("date") < 5) & ~holiday, "close_sec": close})
    trading = F.when(F.col("is_trading"), F.col("date"))
    ahead = W.orderBy(F.desc("date"))  # backwards: a frame that grows, where one that shrinks would be summed up anew for each row
    return days.withColumns(
        {
            "next_on_or_after": F.min(trading).over(ahead.rowsBetween(W.unboundedPreceding, 0)),
            "next_after": F.min(trading).over(ahead.rowsBetween(W.unboundedPreceding, -1)),
            "prev": F.max(trading).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)),
        }
    )


def assign_sessions(rows: DataFrame, calendar: DataFrame, ts: str = "published_ts", day: str = "published_date") -> DataFrame:
    """``rows`` with signal_date, timing_bucket and session_rule_version.

    ``ts`` is local wall time; where it is null only the day is known.  A day
    that is no trading day gives weekend_or_holiday, whatever the time; unknown
    times on trading days roll to the next session.
    """
    c = F.broadcast(calendar.select(F.col("date").alias("_day"), "is_trading", "close_sec", "next_on_or_after", "next_after"))
    local_day = F.coalesce(F.to_date(F.col(ts)), F.col(day))
    sec = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    bucket = (
        F.when(F.col("is_trading").isNull(), None)
        .when(~F.col("is_trading"), "weekend_or_holiday")
        .when(F.col(ts).isNull(), "unknown")
        .when(sec < OPEN_SEC, "pre_open")
        .when(sec <= F.col("close_sec"), "during_session")
        .otherwise("post_close")
    )
    date = F.when(bucket.isin("unknown", "post_close"), F.col("next_after")).when(bucket == "weekend_or_holiday", F.col("next_on_or_after")).otherwise(local_day)
    joined = rows.join(c, local_day == F.col("_day"), "left")
    return joined.withColumns({"signal_date": F.when(bucket.isNotNull(), date), "timing_bucket": bucket, "session_rule_version": F.lit(SESSION_RULE)}).drop(
        "_day", "is_trading", "close_sec", "next_on_or_after", "next_after"
    )


def expected_session(rows: DataFrame, calendar: DataFrame, ts: str = "published_ts", day: str = "published_date") -> DataFrame:
    """An independent derivation for audits: the first session that can still react, found as the earliest close not before the time."""
    sessions = calendar.where("is_trading").select(F.col("date").alias("_s"), "close_sec")
    local_day = F.coalesce(F.to_date(F.col(ts)), F.col(day))
    sec = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    reacts = (F.col("_s") > F.col("_d")) | ((F.col("_s") == F.col("_d")) & F.col("_sec").isNotNull() & (F.col("_sec") <= F.col("close_sec")))
    days = rows.select(local_day.alias("_d"), sec.alias("_sec")).distinct().join(F.broadcast(sessions), reacts & (F.datediff("_s", "_d") < 40))
    found = days.groupBy("_d", "_sec").agg(F.min("_s").alias("expected_date"))
    on = (local_day == F.col("_d")) & sec.eqNullSafe(F.col("_sec"))
    return rows.join(found, on, "left").drop("_d", "_sec")


def backfill_sessions(rows: DataFrame, calendar: DataFrame, version: str = SESSION_RULE, **columns: str) -> DataFrame:
    """Recomputes sessions of rows under another rule version; the others stay as they are."""
    stale = ~F.col("session_rule_version").eqNullSafe(F.lit(version))
    redone = assign_sessions(rows.where(stale).drop("signal_date", "timing_bucket", "session_rule_version"), calendar, **columns)
    return rows.where(~stale).unionByName(redone.select(*rows.columns))


def timing_audit(assigned: DataFrame, calendar: DataFrame, **columns: str) -> DataFrame:
    """For each bucket: rows, rows whose date is the expected one, and a verdict."""
    both = expected_session(assigned, calendar, **columns)
    same = F.col("signal_date").eqNullSafe(F.col("expected_date"))
    out = both.groupBy("timing_bucket").agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("n_same"))
    return out.withColumn("verdict", F.when(F.col("n") == F.col("n_same"), "PASS").otherwise("FAIL"))


def calendar_gaps(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Trading days between the first and last bar without a bar."""
    span = bars.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = calendar.where("is_trading").join(F.broadcast(span), F.col("date").between(F.col("_a"), F.col("_b")))
    return days.join(bars.select("date"), "date", "left_anti").select("date")


def eligible(timing_bucket: Column, is_recap: Column, conflict: Column) -> Column:
    """Why a row is not timing-eligible, null if it is: recap, then during the session, unknown time, conflicting times."""
    return F.when(is_recap, "market_recap").when(timing_bucket == "during_session", "during_session").when(timing_bucket == "unknown", "unknown_time").when(conflict, "timing_conflict")
