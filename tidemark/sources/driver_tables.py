"""Domain views over the benchmark tables: scored headlines, bars, factors and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import clamp, label_of

#: Category by event type, and family by category.
CATEGORY = {"view": "fx_lira", "click": "rates_tcmb", "purchase": "bist_company", "signup": "turkey_macro", "error": "political_risk"}
FAMILY = {"fx_lira": "currency", "rates_tcmb": "monetary_policy", "bist_company": "companies", "turkey_macro": "macro", "political_risk": "politics"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(column: str, table: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored headline for each event; see HEADLINES_SQL for the same in SQL."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    h = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("outlet_"), F.col("user_id") % 11).alias("source"),
        F.to_date("ts").alias("published_date"),
        F.when(F.col("event_id") % 8 != 0, F.col("ts")).alias("published_ts"),
        _when("event_type", CATEGORY).alias("category"),
        F.when(F.col("event_id") % 17 != 0, clamp((F.col("value") - 50) / F.lit(97.0))).alias("score"),
        F.when(F.col("event_id") % 23 != 0, (k + 1) / F.lit(101.0)).alias("relevance"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 37).alias("event_ref"),
        (F.col("event_id") % 13 == 0).cast("int").alias("is_recap"),
        (F.col("event_id") % 29 == 0).cast("int").alias("is_ambiguous"),
    )
    return h.withColumns({"label": label_of(F.col("score")), "family": _when("category", FAMILY), "hour": F.hour("published_ts")})


HEADLINES_SQL = """
headlines AS (
  SELECT *, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' WHEN score IS NOT NULL THEN 'neutral' END AS label,
         CASE category WHEN 'fx_lira' THEN 'currency' WHEN 'rates_tcmb' THEN 'monetary_policy' WHEN 'bist_company' THEN 'companies' WHEN 'turkey_macro' THEN 'macro' WHEN 'political_risk' THEN 'politics' END AS family,
         CAST(extract(hour FROM published_ts) AS INTEGER) AS hour
  FROM (
    SELECT event_id AS id, 'outlet_' || (user_id % 11) AS source, CAST(ts AS DATE) AS published_date,
           CASE WHEN event_id % 8 <> 0 THEN ts END AS published_ts,
           CASE event_type WHEN 'view' THEN 'fx_lira' WHEN 'click' THEN 'rates_tcmb' WHEN 'purchase' THEN 'bist_company' WHEN 'signup' THEN 'turkey_macro' WHEN 'error' THEN 'political_risk' END AS category,
           CASE WHEN event_id % 17 <> 0 THEN greatest(-1.0, least(1.0, (value - 50) / CAST(97.0 AS DOUBLE))) END AS score,
           CASE WHEN event_id % 23 <> 0 THEN (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) / CAST(101.0 AS DOUBLE) END AS relevance,
           CASE WHEN event_id % 3 <> 0 THEN user_id % 37 END AS event_ref,
           CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS is_recap, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS is_ambiguous
    FROM events) h0
)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source and title for each document: its whole text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("title"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values.  The first and last value of a day are those of the lowest and highest (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.to_date("ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


BARS_SQL = """
bars AS (
  SELECT date, max(CASE WHEN i = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN j = 1 THEN value END) AS close, count(*) AS volume
  FROM (SELECT CAST(ts AS DATE) AS date, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS i,
               row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS j FROM events) b0
  GROUP BY date
)"""


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily close from orders, over years: for regressions that need history."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / F.lit(97.0)).alias("close"), F.count("*").alias("volume"))


LONG_BARS_SQL = """
long_bars AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / CAST(97.0 AS DOUBLE) AS close, count(*) AS volume FROM orders GROUP BY 1)"""


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily close for each order priority, as a market factor."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")).agg(F.avg("o_totalprice").alias("close"))


FACTORS_SQL = """
factors AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS symbol, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"""


def observations(h: DataFrame) -> DataFrame:
    """Who carried each headline: its own source, and a second one for every seventh."""
    again = h.where("id % 7 = 0").select("id", F.concat(F.lit("outlet_"), (F.col("id") % 5)).alias("source"))
    return h.select("id", "source").unionByName(again)


OBSERVATIONS_SQL = """
observations AS (SELECT id, source FROM headlines UNION ALL SELECT id, 'outlet_' || (id % 5) FROM headlines WHERE id % 7 = 0)"""


def exclusions(h: DataFrame) -> DataFrame:
    """History of exclusions: headlines of low relevance, restored again for every fifth id."""
    return h.where("relevance < 0.25").select(F.col("id").alias("headline_id"), F.lit("low_relevance").alias("reason"), (F.col("id") % 5 == 0).alias("restored"))


EXCLUSIONS_SQL = """
exclusions AS (SELECT id AS headline_id, 'low_relevance' AS reason, id % 5 = 0 AS restored FROM headlines WHERE relevance < 0.25)"""
