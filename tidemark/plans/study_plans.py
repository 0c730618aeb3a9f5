"""Queries on eligibility, session measures, modelling rows and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events, market, signals
from tidemark.plans.common import assigned, shown, sql, trading_calendar
from tidemark.plans.text_plans import EVENT_GROUPS, _groups
from tidemark.sources import driver_tables as d

QUERIES, SQL = {}, {}
BOUNDARY, THIN = "2024-01-20", 3


def query(text_: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text_:
            SQL[f.__name__] = text_
        return f

    return register


def _scored(spark, sf_dir):
    """Headlines with the columns that scoring leaves."""
    i, s = F.col("id"), F.col("score")
    return assigned(spark, sf_dir).withColumns(
        {
            "processing_status": F.when(s.isNull() & (i % 34 == 0), "failed").when(s.isNull(), "retry_pending").otherwise("scored"),
            "model_name": F.when(i % 31 != 0, F.concat(F.lit("model_"), (i % 2).cast("string"))),
            "scored_at": F.when(i % 37 != 0, F.col("published_date")),
            "p_positive": F.when(i % 41 != 0, F.greatest(s, F.lit(0.0))),
            "p_negative": F.greatest(-s, F.lit(0.0)),
            "p_neutral": 1 - F.abs(s),
        }
    )


SCORED = """scored AS (SELECT *, CASE WHEN score IS NULL AND id % 34 = 0 THEN 'failed' WHEN score IS NULL THEN 'retry_pending' ELSE 'scored' END AS processing_status, CASE WHEN id % 31 <> 0 THEN 'model_' || (id % 2) END AS model_name,
CASE WHEN id % 37 <> 0 THEN published_date END AS scored_at, CASE WHEN id % 41 <> 0 THEN greatest(score, 0) END AS p_positive, greatest(-score, 0) AS p_negative, 1 - abs(score) AS p_neutral FROM assigned)"""
ACTIVE = "id NOT IN (SELECT headline_id FROM exclusions WHERE NOT restored)"


@query(sql("assigned exclusions", f"""WITH {SCORED}, ev AS (SELECT id AS headline_id, family || ':' || event_ref AS event_id FROM scored WHERE event_ref IS NOT NULL)
SELECT id, model_name, CAST(signal_date AS VARCHAR) AS signal_date, event_id FROM scored LEFT JOIN ev ON headline_id = id WHERE processing_status = 'scored' AND score IS NOT NULL AND label IS NOT NULL AND model_name IS NOT NULL AND scored_at IS NOT NULL AND p_positive IS NOT NULL AND p_neutral IS NOT NULL AND p_negative IS NOT NULL AND published_date IS NOT NULL AND {ACTIVE}"""))
def full_eligibility(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    membership = rows.where("event_ref IS NOT NULL").select("id", F.concat_ws(":", "family", "event_ref").alias("event_id"))
    out = signals.fully_eligible(rows, d.exclusions(rows)).join(membership, "id", "left")
    return shown(out.select("id", "model_name", "signal_date", "event_id"))


@query(sql("assigned exclusions", f"WITH {SCORED} SELECT id, source, processing_status FROM scored WHERE processing_status IN ('pending', 'retry_pending') AND {ACTIVE}"))
def unscored_queue(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return shown(signals.unscored_queue(rows, d.exclusions(rows)).orderBy("id").select("id", "source", "processing_status"))


@query(sql("eligible", f"SELECT CAST(signal_date AS VARCHAR) AS signal_date, family, count(score) AS headline_count, round(avg(score), 6) AS mean FROM eligible GROUP BY 1, 2 HAVING count(score) >= {THIN}"))
def thin_session_gate(spark, sf_dir):
    from tidemark.plans.common import eligible

    v = signals.signal_variants(eligible(spark, sf_dir), "signal_date", "family").where(F.col("headline_count") >= THIN)
    return shown(v.select("signal_date", "family", "headline_count", F.col("simple_mean").alias("mean")))


@query(sql("assigned", f"SELECT CASE WHEN signal_date >= DATE '{BOUNDARY}' THEN 'holdout' WHEN signal_date IS NOT NULL THEN 'development' END AS epoch, count(*) AS n, CAST(min(signal_date) AS VARCHAR) AS first_session, CAST(max(signal_date) AS VARCHAR) AS last_session FROM assigned GROUP BY 1"))
def corpus_epochs(spark, sf_dir):
    e = signals.epochs(assigned(spark, sf_dir), "signal_date", BOUNDARY)
    return shown(e.groupBy("epoch").agg(F.count("*").alias("n"), F.min("signal_date").alias("first_session"), F.max("signal_date").alias("last_session")))


EVENTS_SQL = f"""{EVENT_GROUPS}, src AS (SELECT group_key, signal_date, CASE WHEN count(m) >= 2 THEN stddev_pop(m) END AS x FROM (SELECT group_key, signal_date, source, avg(score) AS m FROM g0 GROUP BY 1, 2, 3) y GROUP BY 1, 2),
e AS (SELECT g0.group_key, g0.signal_date AS session, count(*) AS hc, count(DISTINCT source) AS sc, avg(score) AS tone, max(relevance) AS novelty, max(x) AS csd FROM g0 JOIN src ON src.group_key = g0.group_key AND src.signal_date = g0.signal_date GROUP BY 1, 2)"""


@query(sql("assigned", f"""WITH {EVENTS_SQL} SELECT CAST(session AS VARCHAR) AS session, count(*) AS event_count, CAST(sum(hc) AS BIGINT) AS headline_count, CAST(sum(sc) AS BIGINT) AS source_breadth, round(avg(tone), 6) AS mean_tone, round(sum(tone * sc) / sum(CASE WHEN tone IS NOT NULL THEN sc END), 6) AS breadth_weighted_tone,
CASE WHEN count(tone) >= 2 THEN round(stddev_pop(tone), 6) END AS tone_dispersion, round(count(CASE WHEN tone > 0 THEN 1 END) / nullif(count(tone), 0), 6) AS positive_share, round((count(CASE WHEN tone > 0 THEN 1 END) - count(CASE WHEN tone < 0 THEN 1 END)) / nullif(count(tone), 0), 6) AS net_tone_share,
round(max(novelty), 6) AS max_novelty, count(CASE WHEN sc > 1 THEN 1 END) AS multi_source_events, round(avg(csd), 6) AS mean_cross_source_dispersion FROM e GROUP BY session"""))
def session_rules(spark, sf_dir):
    g = _groups(spark, sf_dir)
    key = ["group_key", F.col("signal_date").alias("session")]
    spread = g.groupBy(*key, "source").agg(F.avg("score").alias("m")).groupBy("group_key", "session").agg(F.when(F.count("m") >= 2, F.stddev_pop("m")).alias("cross_source_std"))
    e = g.groupBy(*key).agg(F.count("*").alias("headline_count"), F.count_distinct("source").alias("source_count"), F.avg("score").alias("mean_sentiment"), F.max("relevance").alias("novelty"))
    return shown(events.session_rules(e.join(spread, ["group_key", "session"])))


DATASET = f"""{EVENT_GROUPS}, w AS (SELECT group_key, signal_date AS session, count(*) AS hc, count(DISTINCT source) AS sc, min(timing_bucket) AS b, count(DISTINCT timing_bucket) > 1 AS conflict FROM g0 GROUP BY 1, 2),
r AS (SELECT b.date, (b.close / p.close - 1) * 100 AS y FROM bars b JOIN calendar c ON c.date = b.date JOIN bars p ON p.date = c.prev)"""


@query(sql("assigned bars", f"""WITH {DATASET} SELECT group_key, CAST(session AS VARCHAR) AS session, round(y, 6) AS raw_return FROM w JOIN r ON r.date = w.session WHERE y IS NOT NULL AND b <> 'during_session' AND NOT conflict AND hc > 1 AND sc > 1"""))
def modelling_rows(spark, sf_dir):
    w = _groups(spark, sf_dir).groupBy("group_key", F.col("signal_date").alias("session")).agg(F.count("*").alias("headline_count"), F.count_distinct("source").alias("source_count"), F.min("timing_bucket").alias("bucket"), (F.count_distinct("timing_bucket") > 1).alias("timing_conflict"))
    r = market.market_return_series(trading_calendar(spark), d.bars(spark, sf_dir)).select(F.col("date").alias("session"), F.col("market_return").alias("raw_return"))
    rows = w.join(r, "session", "left").withColumns({"window_name": F.lit("gap_and_session"), "is_eligible": F.lit(1), "is_tradable": (F.col("bucket") != "during_session").cast("int")})
    return shown(events.modelling_rows(rows, exclude_singletons=True, multi_source_only=True).select("group_key", "session", "raw_return"))


@query(sql("assigned", f"""WITH {EVENT_GROUPS}, g AS (SELECT group_key, count(*) AS hc, count(DISTINCT source) AS sc, count(CASE WHEN published_ts IS NULL THEN 1 END) AS u, count(CASE WHEN is_recap = 1 THEN 1 END) AS rc, count(DISTINCT signal_date) AS ns, CASE WHEN min(event_ref) % 3 <> 0 THEN 'E' END AS pe, CASE WHEN min(event_ref) % 2 = 0 THEN 'confirmed' END AS rs FROM g0 GROUP BY 1)
SELECT group_key, array_to_string(list_filter([CASE WHEN sc = 1 THEN 'single_source_group' END, CASE WHEN hc = 1 THEN 'single_headline_group' END, CASE WHEN u > 0 THEN 'unknown_publication_time' END, CASE WHEN rc > 0 AND rc = hc THEN 'market_recap_only' END, CASE WHEN pe IS NULL THEN 'no_recognised_entity' END, CASE WHEN ns > 1 THEN 'spans_multiple_signal_dates' END, CASE WHEN rs IS NULL THEN 'grouping_not_human_reviewed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM g"""))
def brief_warnings(spark, sf_dir):
    m = _groups(spark, sf_dir)
    state = m.groupBy("group_key").agg(F.when(F.min("event_ref") % 3 != 0, "E").alias("primary_entity"), F.when(F.min("event_ref") % 2 == 0, "confirmed").alias("review_state"))
    g = events.summarise_events(m).join(state, "group_key")
    return shown(g.select("group_key", F.array_join(events.quality_warnings(g), ",").alias("warnings")))


@query(sql("assigned bars", f"WITH {DATASET} SELECT count(DISTINCT w.session) AS sessions, count(DISTINCT CASE WHEN y IS NOT NULL THEN w.session END) AS covered FROM w LEFT JOIN r ON r.date = w.session"))
def residual_coverage(spark, sf_dir):
    s = assigned(spark, sf_dir).where("event_ref IS NOT NULL").select(F.col("signal_date").alias("session")).distinct()
    r = market.market_return_series(trading_calendar(spark), d.bars(spark, sf_dir)).select(F.col("date").alias("session"), "market_return")
    return shown(s.join(r, "session", "left").agg(F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(F.col("market_return").isNotNull(), F.col("session"))).alias("covered")))
