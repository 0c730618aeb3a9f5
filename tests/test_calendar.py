from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar


@pytest.fixture(scope="module")
def days(spark):
    return calendar.build_calendar(spark, "2023-12-25", "2024-02-15", ["2024-01-01"], {"2024-01-19": 46_800}).cache()


CASES = [
    (datetime(2024, 1, 10, 9, 59, 59), "pre_open", date(2024, 1, 10)),
    (datetime(2024, 1, 10, 10, 0, 0), "during_session", date(2024, 1, 10)),
    (datetime(2024, 1, 10, 18, 10, 0), "during_session", date(2024, 1, 10)),
    (datetime(2024, 1, 10, 18, 10, 1), "post_close", date(2024, 1, 11)),
    (datetime(2024, 1, 19, 13, 0, 0), "during_session", date(2024, 1, 19)),
    (datetime(2024, 1, 19, 13, 0, 1), "post_close", date(2024, 1, 22)),
    (datetime(2024, 1, 13, 12, 0, 0), "weekend_or_holiday", date(2024, 1, 15)),
    (datetime(2024, 1, 1, 12, 0, 0), "weekend_or_holiday", date(2024, 1, 2)),
]


def test_boundaries(spark, days):
    rows = spark.createDataFrame([(i, t, t.date()) for i, (t, _, _) in enumerate(CASES)], "id int, published_ts timestamp_ntz, published_date date")
    got = {r["id"]: (r["timing_bucket"], r["signal_date"]) for r in calendar.assign_sessions(rows, days).collect()}
    assert got == {i: (b, d) for i, (_, b, d) in enumerate(CASES)}


def test_unknown_time(spark, days):
    rows = spark.createDataFrame([(1, None, date(2024, 1, 10)), (2, None, date(2024, 1, 13)), (3, None, None)], "id int, published_ts timestamp_ntz, published_date date")
    got = {r["id"]: (r["timing_bucket"], r["signal_date"]) for r in calendar.assign_sessions(rows, days).collect()}
    assert got == {1: ("unknown", date(2024, 1, 11)), 2: ("weekend_or_holiday", date(2024, 1, 15)), 3: (None, None)}


def test_independent_derivation_agrees(spark, days):
    rows = spark.range(0, 2000).select("id", (F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 17).cast("int"))).alias("published_ts"))
    rows = rows.withColumn("published_date", F.to_date("published_ts"))
    rows = rows.withColumn("published_ts", F.when(F.col("id") % 7 != 0, F.col("published_ts")))
    audit = calendar.timing_audit(calendar.assign_sessions(rows, days), days).collect()
    assert {r["verdict"] for r in audit} == {"PASS"} and sum(r["n"] for r in audit) == 2000


def test_backfill_leaves_current_rows(spark, days):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 10, 9), date(2024, 1, 10))], "id int, published_ts timestamp_ntz, published_date date")
    new = calendar.assign_sessions(rows, days)
    old = new.withColumns({"signal_date": F.lit("2020-01-01").cast("date"), "session_rule_version": F.lit("old")}).withColumn("id", F.lit(2))
    got = {r["id"]: r["signal_date"] for r in calendar.backfill_sessions(new.unionByName(old), days).collect()}
    assert got == {1: date(2024, 1, 10), 2: date(2024, 1, 10)}


def test_gaps(spark, days):
    bars = spark.createDataFrame([(date(2024, 1, 2),), (date(2024, 1, 4),)], "date date")
    assert [r[0] for r in calendar.calendar_gaps(days, bars).collect()] == [date(2024, 1, 3)]
