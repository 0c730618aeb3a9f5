"""Queries on sessions, signal variants, family signals and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calendar, indicators, signals
from tidemark.plans.common import assigned, eligible, shown, sql, trading_calendar
from tidemark.sources import driver_tables as d

QUERIES, SQL = {}, {}
PRO, OPPOSITION, OFFICIAL = ["outlet_0", "outlet_1", "outlet_2"], ["outlet_3", "outlet_4", "outlet_5"], ["outlet_6", "outlet_7"]
DOMESTIC = ["companies", "macro", "monetary_policy"]


def query(text: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return register


VARIANTS = """
count(score) AS headline_count, count(*) AS input_count, count(*) - count(score) AS excluded_incomplete_score_count,
count(CASE WHEN label = 'positive' THEN 1 END) AS positive_count, count(CASE WHEN label = 'negative' THEN 1 END) AS negative_count, count(CASE WHEN label = 'neutral' THEN 1 END) AS neutral_count,
count(score) - count(label) AS unclassified_count,
round(avg(score), 6) AS simple_mean, round(sum(score * r) / nullif(sum(r), 0), 6) AS relevance_weighted, round(sum(score * r * i) / nullif(sum(r * i), 0), 6) AS intensity_relevance_weighted,
round(sum(score * r * i * t) / nullif(sum(r * i * t), 0), 6) AS full_weighted, round(stddev_pop(score), 6) AS dispersion,
count(DISTINCT CASE WHEN score IS NOT NULL THEN source END) AS source_count, count(DISTINCT CASE WHEN score IS NOT NULL THEN event_ref END) AS event_count,
round(coalesce(sum(r), 0), 6) AS relevance_weight_sum, round(coalesce(sum(r * i), 0), 6) AS intensity_relevance_weight_sum, round(coalesce(sum(r * i * t), 0), 6) AS full_weight_sum,
round(count(CASE WHEN label = 'positive' THEN 1 END) / nullif(count(score), 0), 6) AS positive_share, round(count(CASE WHEN label = 'negative' THEN 1 END) / nullif(count(score), 0), 6) AS negative_share, round(count(CASE WHEN label = 'neutral' THEN 1 END) / nullif(count(score), 0), 6) AS neutral_share
"""
WEIGHED = """(SELECT *, CASE WHEN score IS NOT NULL THEN coalesce(relevance, 1.0) END AS r, greatest(abs(score), 0.1) AS i,
  CASE WHEN hour IS NULL THEN 1.0 WHEN hour < 10 THEN 1.5 WHEN hour <= 18 THEN 1.0 ELSE 0.8 END AS t FROM {})"""


@query(sql("eligible", f"SELECT CAST(signal_date AS VARCHAR) AS signal_date, {VARIANTS} FROM {WEIGHED.format('eligible')} x GROUP BY 1"))
def signal_variants_by_session(spark, sf_dir):
    return shown(signals.signal_variants(eligible(spark, sf_dir), "signal_date"))


@query(sql("assigned", f"SELECT CAST(published_date AS VARCHAR) AS published_date, {VARIANTS} FROM {WEIGHED.format('assigned')} x GROUP BY 1"))
def signal_variants_by_day(spark, sf_dir):
    return shown(signals.signal_variants(assigned(spark, sf_dir), "published_date"))


@query(sql("eligible", "SELECT CAST(signal_date AS VARCHAR) AS signal_date, category, count(*) AS n, round(avg(score), 6) AS mean_score FROM eligible GROUP BY GROUPING SETS ((signal_date, category), (signal_date))"))
def category_session_means(spark, sf_dir):
    rows = eligible(spark, sf_dir)
    return shown(rows.groupingSets([["signal_date", "category"], ["signal_date"]], "signal_date", "category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


@query(sql("eligible", "SELECT CAST(signal_date AS VARCHAR) AS signal_date, round(sum(score * r * i * t) / nullif(sum(r * i * t), 0), 6) AS avg_score, round(count(CASE WHEN label = 'positive' THEN 1 END) / nullif(count(CASE WHEN label <> 'neutral' THEN 1 END), 0), 6) AS bull_bear FROM " + WEIGHED.format("eligible") + " x GROUP BY 1"))
def legacy_daily_rows(spark, sf_dir):
    return shown(signals.legacy_row(signals.signal_variants(eligible(spark, sf_dir), "signal_date")).select("signal_date", "avg_score", "bull_bear"))


@query(sql("assigned", "SELECT CAST(signal_date AS VARCHAR) AS signal_date, timing_bucket, count(*) AS n FROM assigned GROUP BY 1, 2"))
def session_assignment_counts(spark, sf_dir):
    return shown(assigned(spark, sf_dir).groupBy("signal_date", "timing_bucket").agg(F.count("*").alias("n")))


@query(sql("assigned", "SELECT id, CAST(published_date AS VARCHAR) AS published_date, CAST(signal_date AS VARCHAR) AS signal_date FROM assigned WHERE timing_bucket = 'unknown'"))
def unknown_timing_rollforward(spark, sf_dir):
    return shown(assigned(spark, sf_dir).where("timing_bucket = 'unknown'").select("id", "published_date", "signal_date"))


@query(sql("assigned", "SELECT timing_bucket, count(*) AS n, count(*) AS n_same, 'PASS' AS verdict FROM assigned GROUP BY 1"))
def timing_audit_verdicts(spark, sf_dir):
    return shown(calendar.timing_audit(assigned(spark, sf_dir), trading_calendar(spark)))


@query(sql("eligible observations", """
WITH b AS (
  SELECT signal_date, family, round(avg(score), 6) AS simple_mean, round(sum(score * coalesce(relevance, 1.0)) / nullif(sum(coalesce(relevance, 1.0)), 0), 6) AS relevance_weighted, round(median(score), 6) AS median_sentiment,
         round(min(score), 6) AS min_sentiment, round(max(score), 6) AS max_sentiment, CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 6) END AS sentiment_std, count(score) AS headline_count,
         round(avg(relevance), 6) AS avg_relevance, CAST(sum(is_recap) AS BIGINT) AS market_recap_count, count(CASE WHEN timing_bucket = 'unknown' THEN 1 END) AS unknown_timing_count,
         count(*) - count(score) AS unresolved_count, CAST(sum(is_ambiguous) AS BIGINT) AS ambiguous_count
  FROM eligible GROUP BY 1, 2
), c AS (SELECT signal_date, family, count(DISTINCT o.source) AS source_count FROM eligible e JOIN observations o ON o.id = e.id GROUP BY 1, 2)
SELECT CAST(b.signal_date AS VARCHAR) AS signal_date, b.* EXCLUDE (signal_date), source_count,
       CASE WHEN headline_count = 0 THEN 'insufficient' WHEN headline_count < 3 THEN 'thin' WHEN source_count < 2 THEN 'single_source' ELSE 'sufficient' END AS sample_sufficiency
FROM b JOIN c ON b.signal_date = c.signal_date AND b.family = c.family"""))
def family_session_signals(spark, sf_dir):
    rows = eligible(spark, sf_dir)
    return shown(signals.family_signals(rows, d.observations(d.headlines(spark, sf_dir)), "signal_date", "family"))


@query(sql("eligible", f"SELECT CAST(signal_date AS VARCHAR) AS signal_date, '__domestic__' AS family, count(*) AS n, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score FROM eligible WHERE family IN ('companies', 'macro', 'monetary_policy') GROUP BY 1"))
def domestic_composite(spark, sf_dir):
    rows = signals.with_composite(eligible(spark, sf_dir), DOMESTIC).where(F.col("family") == signals.COMPOSITE)
    return shown(rows.groupBy("signal_date", "family").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score")))


DISAGREEMENT = """
WITH src AS (SELECT signal_date, family, source, avg(score) AS m FROM eligible GROUP BY 1, 2, 3),
o AS (SELECT signal_date, family, count(*) AS source_count, stddev_pop(m) AS om, max(m) - min(m) AS rng FROM src GROUP BY 1, 2),
g AS (
  SELECT signal_date, family, count(*) AS headline_count, stddev_pop(score) AS sd, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS sp, avg(CASE WHEN score <= -0.5 THEN 1.0 ELSE 0.0 END) AS sn,
         avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN label = 'neutral' THEN 1.0 ELSE 0.0 END) AS u, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS n,
         avg(score) FILTER (source IN ('outlet_0', 'outlet_1', 'outlet_2')) - avg(score) FILTER (source IN ('outlet_3', 'outlet_4', 'outlet_5')) AS camp_gap,
         count(DISTINCT source) FILTER (source IN ('outlet_0', 'outlet_1', 'outlet_2', 'outlet_3', 'outlet_4', 'outlet_5')) AS camps,
         avg(score) FILTER (source IN ('outlet_6', 'outlet_7')) - avg(score) FILTER (source NOT IN ('outlet_6', 'outlet_7')) AS official
  FROM eligible GROUP BY 1, 2)
SELECT CAST(g.signal_date AS VARCHAR) AS signal_date, g.family, headline_count, source_count, CASE WHEN headline_count > 1 THEN round(sd, 6) END AS within_day_std,
       CASE WHEN source_count >= 3 THEN round(om, 6) END AS cross_outlet_std, CASE WHEN source_count >= 3 THEN round(rng, 6) END AS max_minus_min, round(sp, 6) AS strong_positive_share, round(sn, 6) AS strong_negative_share,
       round((CASE WHEN p > 0 THEN -p * ln(p) / ln(3) ELSE 0 END) + (CASE WHEN u > 0 THEN -u * ln(u) / ln(3) ELSE 0 END) + (CASE WHEN n > 0 THEN -n * ln(n) / ln(3) ELSE 0 END), 6) AS sentiment_entropy,
       round(camp_gap, 6) AS camp_gap, CAST(CASE WHEN camp_gap IS NOT NULL THEN camps END AS DOUBLE) AS camp_gap_sources, round(official, 6) AS official_vs_media_gap, CAST(CASE WHEN source_count >= 3 THEN 1 ELSE 0 END AS BIGINT) AS min_sources_met
FROM g JOIN o ON g.signal_date = o.signal_date AND g.family = o.family"""


@query(sql("eligible", DISAGREEMENT))
def disagreement_daily(spark, sf_dir):
    return shown(indicators.disagreement(eligible(spark, sf_dir), PRO, OPPOSITION, OFFICIAL))


@query(sql("eligible", """WITH s AS (SELECT signal_date, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN label = 'neutral' THEN 1.0 ELSE 0.0 END) AS u, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS n FROM eligible GROUP BY 1)
SELECT CAST(signal_date AS VARCHAR) AS signal_date, round((CASE WHEN p > 0 THEN -p * ln(p) / ln(3) ELSE 0 END) + (CASE WHEN u > 0 THEN -u * ln(u) / ln(3) ELSE 0 END) + (CASE WHEN n > 0 THEN -n * ln(n) / ln(3) ELSE 0 END), 6) AS entropy FROM s"""))
def label_entropy(spark, sf_dir):
    share = lambda x: F.avg((F.col("label") == x).cast("double"))
    g = eligible(spark, sf_dir).groupBy("signal_date").agg(share("positive").alias("p"), share("neutral").alias("u"), share("negative").alias("n"))
    return shown(g.select("signal_date", indicators.entropy3(F.col("p"), F.col("u"), F.col("n")).alias("entropy")))


TONE = """
WITH m AS (
  SELECT CASE g WHEN 1 THEN 'source' WHEN 2 THEN 'family' ELSE 'source_family' END AS scope, CASE g WHEN 1 THEN source WHEN 2 THEN family ELSE source || '|' || family END AS key, signal_date, mean_score, n
  FROM (SELECT signal_date, source, family, avg(score) AS mean_score, count(*) AS n, GROUPING(signal_date, source, family) AS g FROM eligible GROUP BY GROUPING SETS ((signal_date, source), (signal_date, family), (signal_date, source, family))) x
), w AS (
  SELECT *, count(mean_score) OVER v AS prior_n, avg(mean_score) OVER v AS pm, stddev_pop(mean_score) OVER v AS ps, list(mean_score) OVER v AS h
  FROM m WINDOW v AS (PARTITION BY scope, key ORDER BY signal_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)
SELECT scope, key, CAST(signal_date AS VARCHAR) AS signal_date, round(mean_score, 6) AS mean_score, n, prior_n, CASE WHEN prior_n >= 5 THEN round(pm, 6) END AS prior_mean, CASE WHEN prior_n >= 5 THEN round(ps, 6) END AS prior_std,
       CASE WHEN prior_n >= 5 AND ps > 1e-12 THEN round((mean_score - pm) / ps, 6) END AS z_score, CASE WHEN prior_n >= 5 THEN round(len(list_filter(h, lambda a: a <= mean_score)) / prior_n, 6) END AS percentile
FROM w"""


@query(sql("eligible", TONE))
def abnormal_tone_grouping_sets(spark, sf_dir):
    return shown(indicators.abnormal_tone(eligible(spark, sf_dir)))


for _scope in ("source", "family", "source_family"):

    def _tone(spark, sf_dir, scope=_scope):
        return shown(indicators.abnormal_tone(eligible(spark, sf_dir)).where(F.col("scope") == scope))

    QUERIES[f"abnormal_tone_{_scope}"] = _tone
    SQL[f"abnormal_tone_{_scope}"] = sql("eligible", TONE + f" WHERE scope = '{_scope}'")

VOLUME = """
WITH c AS (
  SELECT signal_date, CASE WHEN g = 1 THEN '__all__' ELSE family END AS family, headline_count, observation_count, source_count
  FROM (SELECT signal_date, family, count(*) AS headline_count, count(DISTINCT coalesce('e' || event_ref, 'h' || id)) AS observation_count, count(DISTINCT source) AS source_count, GROUPING(signal_date, family) AS g
        FROM eligible GROUP BY GROUPING SETS ((signal_date, family), (signal_date))) x
), w AS (
  SELECT *, count(*) OVER v AS prior_n, avg(headline_count) OVER v AS pm, stddev_pop(headline_count) OVER v AS ps, list(headline_count) OVER v AS h,
         headline_count - lag(headline_count, 1) OVER o AS change_1, headline_count - lag(headline_count, 5) OVER o AS change_5, headline_count - lag(headline_count, 20) OVER o AS change_20
  FROM c WINDOW v AS (PARTITION BY family ORDER BY signal_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY family ORDER BY signal_date)
)"""


@query(sql("eligible", VOLUME + """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, family, headline_count, observation_count, source_count, prior_n, CASE WHEN prior_n >= 5 THEN round(pm, 6) END AS prior_mean, CASE WHEN prior_n >= 5 THEN round(ps, 6) END AS prior_std,
       CASE WHEN prior_n >= 5 AND ps > 1e-9 THEN round((headline_count - pm) / ps, 6) END AS z_score, CASE WHEN prior_n >= 5 THEN round(len(list_filter(h, lambda a: a <= headline_count)) / prior_n, 6) END AS percentile, CAST(change_1 AS DOUBLE) AS change_1, CAST(change_5 AS DOUBLE) AS change_5, CAST(change_20 AS DOUBLE) AS change_20
FROM w"""))
def volume_shock(spark, sf_dir):
    return shown(indicators.volume_shock(indicators.volume_counts(eligible(spark, sf_dir))))


@query(sql("eligible", VOLUME + " SELECT CAST(signal_date AS VARCHAR) AS signal_date, family, CAST(change_1 AS DOUBLE) AS change_1, CAST(change_5 AS DOUBLE) AS change_5, CAST(change_20 AS DOUBLE) AS change_20 FROM w"))
def volume_changes(spark, sf_dir):
    return shown(indicators.volume_shock(indicators.volume_counts(eligible(spark, sf_dir))).select("signal_date", "family", "change_1", "change_5", "change_20"))


@query(sql("eligible", """
WITH f AS (SELECT signal_date, family, avg(score) AS m FROM eligible GROUP BY 1, 2), i AS (SELECT signal_date, dense_rank() OVER (ORDER BY signal_date) AS i FROM (SELECT DISTINCT signal_date FROM eligible) x),
n AS (SELECT f.*, i FROM f JOIN i ON i.signal_date = f.signal_date)
SELECT CAST(a.signal_date AS VARCHAR) AS signal_date, a.family, round(a.m, 6) AS mean_score, round(a.m - b.m, 6) AS change_5 FROM n a LEFT JOIN n b ON a.family = b.family AND a.i = b.i + 5"""))
def family_change_5_sessions(spark, sf_dir):
    rows = eligible(spark, sf_dir)
    means = rows.groupBy("signal_date", "family").agg(F.avg("score").alias("mean_score"))
    return shown(indicators.change_over_sessions(means, rows, 5, "family", "mean_score").select("signal_date", "family", "mean_score", "change_5"))


@query("")
def regime_report(spark, sf_dir):
    rows = eligible(spark, sf_dir)
    family = signals.family_signals(rows, d.observations(d.headlines(spark, sf_dir)), "signal_date", "family")
    return shown(indicators.regime_report(family, indicators.abnormal_tone(rows), indicators.volume_shock(indicators.volume_counts(rows)), indicators.disagreement(rows, PRO, OPPOSITION, OFFICIAL)))


REGIME = """
WITH fam AS (
  SELECT signal_date, family, avg(score) AS m, median(score) AS med, CASE WHEN count(*) > 1 THEN stddev_pop(score) END AS sd, count(score) AS n, sum(is_recap) AS recaps, count(CASE WHEN timing_bucket = 'unknown' THEN 1 END) AS unknown, count(*) AS all_n,
         arg_min(id, struct_pack(s := -score, i := id)) AS top_item, arg_min(id, struct_pack(s := score, i := id)) AS bottom_item FROM eligible GROUP BY 1, 2
), ix AS (SELECT *, dense_rank() OVER (ORDER BY signal_date) AS i FROM fam),
t AS (SELECT *, count(*) OVER v AS pn, avg(m) OVER v AS pm, stddev_pop(m) OVER v AS ps, list(m) OVER v AS h, avg(all_n) OVER v AS vm, stddev_pop(all_n) OVER v AS vs
      FROM ix WINDOW v AS (PARTITION BY family ORDER BY signal_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN pn >= 5 AND ps > 1e-12 THEN (m - pm) / ps END AS tone_z, CASE WHEN pn >= 5 THEN len(list_filter(h, lambda a: a <= m)) / pn END AS pc, CASE WHEN pn >= 5 AND vs > 1e-9 THEN (all_n - vm) / vs END AS volume_z FROM t)
SELECT CAST(z.signal_date AS VARCHAR) AS signal_date, z.family, round(z.m, 6) AS simple_mean, round(z.med, 6) AS median_sentiment, z.n AS headline_count, round(z.m - a.m, 6) AS vs_5_sessions, round(z.m - b.m, 6) AS vs_20_sessions, round(tone_z, 6) AS tone_z, round(pc, 6) AS tone_percentile,
       round(volume_z, 6) AS volume_z, round(z.sd, 6) AS within_day_std, round(z.recaps / z.n, 6) AS market_recap_share, z.unknown > 0 AS timing_degraded, z.top_item, z.bottom_item,
       coalesce(pc >= 0.9 OR pc <= 0.1, false) AS is_unusual, coalesce(volume_z >= 1.5, false) AS is_elevated, coalesce(z.sd >= 0.3, false) AS is_disagreed
FROM z LEFT JOIN ix a ON a.family = z.family AND a.i = z.i - 5 LEFT JOIN ix b ON b.family = z.family AND b.i = z.i - 20"""


@query(sql("eligible", REGIME))
def regime_families(spark, sf_dir):
    """All families of all sessions, with what the report says of each."""
    rows = eligible(spark, sf_dir)
    family = signals.family_signals(rows, d.observations(d.headlines(spark, sf_dir)), "signal_date", "family")
    volume = indicators.volume_shock(indicators.volume_counts(rows))
    out = indicators.regime_families(family, indicators.abnormal_tone(rows), volume, indicators.disagreement(rows, PRO, OPPOSITION, OFFICIAL), rows)
    shown_ = ("signal_date family simple_mean median_sentiment headline_count vs_5_sessions vs_20_sessions tone_z tone_percentile volume_z within_day_std market_recap_share timing_degraded top_item bottom_item is_unusual is_elevated is_disagreed").split()
    return shown(out.select(*shown_))


@query(sql("eligible", """
WITH c AS (SELECT signal_date, count(*) AS n FROM eligible GROUP BY 1), m AS (SELECT (list_sort(list(n)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM c WHERE n > 0)
SELECT CAST(signal_date AS VARCHAR) AS signal_date, n, CASE WHEN n > med THEN 'high' ELSE 'low' END AS attention FROM c, m"""))
def attention_regime(spark, sf_dir):
    c = eligible(spark, sf_dir).groupBy("signal_date").agg(F.count("*").alias("n"))
    # sessions are days, so their counts are a bounded list
    upper = c.where("n > 0").agg(F.array_sort(F.collect_list("n")).alias("a")).select(F.element_at("a", (F.size("a") / 2).cast("int") + 1).alias("med"))
    return shown(c.crossJoin(F.broadcast(upper)).select("signal_date", "n", F.when(F.col("n") > F.col("med"), "high").otherwise("low").alias("attention")))


@query(sql("eligible", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, round(sum(is_recap) / count(*), 6) AS recap_share FROM eligible GROUP BY 1"""))
def market_recap_share(spark, sf_dir):
    return shown(eligible(spark, sf_dir).groupBy("signal_date").agg((F.sum("is_recap") / F.count("*")).alias("recap_share")))


@query(sql("eligible", """
SELECT signal_date, side, rank, id, score FROM (
  SELECT CAST(signal_date AS VARCHAR) AS signal_date, 'top' AS side, row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM eligible
  UNION ALL SELECT CAST(signal_date AS VARCHAR), 'bottom', row_number() OVER (PARTITION BY signal_date ORDER BY score, id), id, round(score, 6) FROM eligible) x WHERE rank <= 5"""))
def topk_drivers(spark, sf_dir):
    rows = eligible(spark, sf_dir).select("signal_date", "id", "score")
    part = lambda name, order: rows.withColumn("rank", F.row_number().over(W.partitionBy("signal_date").orderBy(order, "id"))).where("rank <= 5").withColumn("side", F.lit(name))
    return shown(part("top", F.desc("score")).unionByName(part("bottom", F.asc("score"))).select("signal_date", "side", "rank", "id", "score"))
