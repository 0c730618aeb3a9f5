"""What the registered queries share: the domain views, in Spark and in SQL, and the form of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import calendar, signals
from tidemark.sources import driver_tables as d

HOLIDAYS, HALF_DAYS = ("2024-01-01",), {"2024-01-19": 46_800}
FIRST, LAST = "1994-12-25", "2024-03-31"

CALENDAR_SQL = f"""
days AS (SELECT CAST(x AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS x) s),
days1 AS (SELECT date, isodow(date) <= 5 AND date <> DATE '2024-01-01' AS is_trading, CASE WHEN date = DATE '2024-01-19' THEN 46800 ELSE 65400 END AS close_sec FROM days),
calendar AS (
  SELECT *, min(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_on_or_after,
         min(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_after,
         max(CASE WHEN is_trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM days1
)"""

SESSIONS_SQL = """
assigned AS (
  SELECT h.*, b AS timing_bucket,
         CASE WHEN b IN ('unknown', 'post_close') THEN next_after WHEN b = 'weekend_or_holiday' THEN next_on_or_after ELSE d END AS signal_date
  FROM (
    SELECT h.*, c.next_after, c.next_on_or_after, c.date AS d,
           CASE WHEN NOT c.is_trading THEN 'weekend_or_holiday' WHEN published_ts IS NULL THEN 'unknown' WHEN s < 36000 THEN 'pre_open' WHEN s <= c.close_sec THEN 'during_session' ELSE 'post_close' END AS b
    FROM (SELECT *, extract(hour FROM published_ts) * 3600 + extract(minute FROM published_ts) * 60 + floor(extract(second FROM published_ts)) AS s FROM headlines) h
    JOIN calendar c ON c.date = coalesce(CAST(h.published_ts AS DATE), h.published_date)
  ) h
)"""

ELIGIBLE_SQL = """
eligible AS (
  SELECT * FROM assigned a WHERE score IS NOT NULL AND label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.headline_id = a.id AND NOT x.restored)
)"""

PARTS = {
    "headlines": d.HEADLINES_SQL, "observations": d.OBSERVATIONS_SQL, "exclusions": d.EXCLUSIONS_SQL, "bars": d.BARS_SQL, "long_bars": d.LONG_BARS_SQL, "factors": d.FACTORS_SQL,
    "calendar": CALENDAR_SQL, "assigned": SESSIONS_SQL, "eligible": ELIGIBLE_SQL,
}
NEEDS = {"observations": ["headlines"], "exclusions": ["headlines"], "assigned": ["headlines", "calendar"], "eligible": ["assigned", "exclusions"]}


def sql(views: str, body: str) -> str:
    """``body`` behind the named views and what they need."""
    order: list[str] = []

    def add(name: str):
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    body = body.strip()
    views_text = ",".join(PARTS[v] for v in order)
    if body.upper().startswith("WITH "):
        return f"WITH {views_text}, {body[5:]}" if order else body
    return f"WITH {views_text}\n{body}" if order else body


def trading_calendar(spark: SparkSession) -> DataFrame:
    return calendar.build_calendar(spark, FIRST, LAST, HOLIDAYS, HALF_DAYS)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.assign_sessions(d.headlines(spark, sf_dir), trading_calendar(spark))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assigned(spark, sf_dir)
    return signals.eligible_headlines(rows, d.exclusions(rows))


def shown(df: DataFrame, places: int = 6) -> DataFrame:
    """Dates as text and doubles rounded, as results of two engines are compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ShortType, T.ByteType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)
