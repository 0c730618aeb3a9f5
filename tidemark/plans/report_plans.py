"""Queries on reports, statistics and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import market, pairs, reports, signals, stats  # noqa: F401
from tidemark.plans.common import assigned, eligible, shown, sql
from tidemark.plans.market_plans import SIGNAL, _signal
from tidemark.plans.signal_plans import OPPOSITION, PRO, WEIGHED
from tidemark.sources import driver_tables as d

QUERIES, SQL = {}, {}
CAMP_SQL = "CASE WHEN source IN ('outlet_0', 'outlet_1', 'outlet_2') THEN 'a' WHEN source IN ('outlet_3', 'outlet_4', 'outlet_5') THEN 'b' END"


def camp():
    return F.when(F.col("source").isin(*PRO), "a").when(F.col("source").isin(*OPPOSITION), "b")


def query(text_: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text_:
            SQL[f.__name__] = text_
        return f

    return register


@query(sql("assigned exclusions", "SELECT count(*) AS n, round(avg(relevance), 6) AS mean_relevance FROM assigned a WHERE NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.headline_id = a.id AND NOT x.restored)"))
def active_exclusion_antijoin(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    return shown(rows.join(signals.active_exclusions(d.exclusions(rows)), "id", "left_anti").agg(F.count("*").alias("n"), F.avg("relevance").alias("mean_relevance")))


@query(sql("headlines exclusions", "SELECT id, source FROM headlines WHERE id IN (SELECT headline_id FROM exclusions WHERE restored)"))
def semi_restored_override(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    return shown(h.join(d.exclusions(h).where("restored").select(F.col("headline_id").alias("id")), "id", "left_semi").select("id", "source"))


RAW = "raw AS (SELECT id, source FROM observations)"


@query(sql("observations", f"WITH {RAW} SELECT id, source, 'raw' AS origin FROM raw UNION ALL SELECT id, source, 'canonical' FROM headlines WHERE id NOT IN (SELECT id FROM raw)"))
def raw_union_canonical(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    raw = d.observations(h)
    rest = h.join(raw.select("id"), "id", "left_anti").select("id", "source", F.lit("canonical").alias("origin"))
    return shown(raw.withColumn("origin", F.lit("raw")).unionByName(rest))


@query(sql("observations", "SELECT h.category, count(DISTINCT o.source) AS breadth, count(DISTINCT h.source) AS own_breadth FROM headlines h JOIN observations o ON o.id = h.id GROUP BY 1"))
def source_union_breadth(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    o = d.observations(h).withColumnRenamed("source", "carrier")
    return shown(h.join(o, "id").groupBy("category").agg(F.count_distinct("carrier").alias("breadth"), F.count_distinct("source").alias("own_breadth")))


@query(sql("headlines", "SELECT source, CAST(published_date AS VARCHAR) AS published_date, category, min(id) AS id FROM headlines GROUP BY 1, 2, 3"))
def dedupe_first_by_identity(spark, sf_dir):
    w = W.partitionBy("source", "published_date", "category").orderBy("id")
    return shown(d.headlines(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("source", "published_date", "category", "id"))


@query(sql("headlines exclusions", """WITH s AS (SELECT h.id, CASE WHEN score IS NULL AND id % 34 = 0 THEN 'failed' WHEN score IS NULL THEN 'retry_pending' ELSE 'scored' END AS status, x.headline_id IS NULL AS ok FROM headlines h LEFT JOIN exclusions x ON x.headline_id = h.id AND NOT x.restored)
SELECT status, count(CASE WHEN ok THEN 1 END) AS eligible, count(CASE WHEN NOT ok THEN 1 END) AS excluded FROM s GROUP BY 1"""))
def processing_status_crosstab(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    x = signals.active_exclusions(d.exclusions(h)).withColumn("x", F.lit(1))
    status = F.when(F.col("score").isNull() & (F.col("id") % 34 == 0), "failed").when(F.col("score").isNull(), "retry_pending").otherwise("scored")
    rows = h.join(x, "id", "left").select(status.alias("status"), F.when(F.col("x").isNull(), "eligible").otherwise("excluded").alias("state"))
    return shown(reports.crosstab(rows, "status", "state", ["eligible", "excluded"]))


@query(sql("eligible", f"WITH c AS (SELECT {CAMP_SQL} AS camp, category, count(*) AS n FROM eligible WHERE {CAMP_SQL} IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY camp) AS share FROM c), p AS (SELECT category, coalesce(max(CASE WHEN camp = 'a' THEN share END), 0) AS a, coalesce(max(CASE WHEN camp = 'b' THEN share END), 0) AS b FROM s GROUP BY 1) SELECT category, round(a, 6) AS a, round(b, 6) AS b, round(0.5 * sum(abs(a - b)) OVER (), 6) AS total_variation FROM p"))
def category_share_total_variation(spark, sf_dir):
    return shown(reports.share_distance(eligible(spark, sf_dir), camp(), "category"))


@query(sql("eligible", f"""WITH g AS (SELECT {CAMP_SQL} AS c, score FROM eligible), a AS (SELECT count(score) FILTER (c = 'a') AS n_a, count(score) FILTER (c = 'b') AS n_b, avg(score) FILTER (c = 'a') AS mean_a, avg(score) FILTER (c = 'b') AS mean_b, var_samp(score) FILTER (c = 'a') AS var_a, var_samp(score) FILTER (c = 'b') AS var_b FROM g)
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(var_a, 6) AS var_a, round(var_b, 6) AS var_b, round(mean_a - mean_b, 6) AS difference, round((mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)), 6) AS cohens_d, round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 6) AS welch_t FROM a"""))
def camp_gap_cohens_d(spark, sf_dir):
    return shown(stats.mean_difference(eligible(spark, sf_dir), camp(), "score"))


GAPS = f"p AS (SELECT event_ref, avg(score) FILTER ({CAMP_SQL} = 'a') AS a, avg(score) FILTER ({CAMP_SQL} = 'b') AS b FROM eligible WHERE event_ref IS NOT NULL GROUP BY 1), q AS (SELECT *, a - b AS gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(sql("eligible", f"WITH {GAPS} SELECT event_ref, round(a, 6) AS a, round(b, 6) AS b, round(gap, 6) AS gap FROM q"))
def shared_event_gap_pivot(spark, sf_dir):
    return shown(reports.shared_event_gaps(eligible(spark, sf_dir).where("event_ref IS NOT NULL"), camp(), "event_ref", "score"))


@query(sql("eligible", f"WITH {GAPS} SELECT count(*) AS events, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(stddev_samp(gap), 6) AS std_gap, round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM q"))
def framing_summary(spark, sf_dir):
    return shown(reports.framing(reports.shared_event_gaps(eligible(spark, sf_dir).where("event_ref IS NOT NULL"), camp(), "event_ref", "score")))


DAILY = "v AS (SELECT signal_date, avg(score) AS simple_mean, sum(score * r) / nullif(sum(r), 0) AS relevance_weighted, sum(score * r * i * t) / nullif(sum(r * i * t), 0) AS full_weighted FROM " + WEIGHED.format("eligible") + " x GROUP BY 1)"
NAMES = ["simple_mean", "relevance_weighted", "full_weighted"]


def _variants(spark, sf_dir):
    return signals.signal_variants(eligible(spark, sf_dir), "signal_date")


@query(sql("eligible", f"WITH {DAILY}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, {n} AS x FROM v" for n in NAMES) + ") SELECT variant, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM u GROUP BY 1"))
def variant_distributions(spark, sf_dir):
    return shown(stats.distribution(_variants(spark, sf_dir), *NAMES))


@query(sql("eligible", f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])))
def variant_correlations(spark, sf_dir):
    return shown(stats.correlations(_variants(spark, sf_dir), NAMES))


@query(sql("eligible", f"WITH {DAILY} SELECT count(*) AS n, round(avg(CASE WHEN sign(simple_mean) = sign(full_weighted) THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(CASE WHEN simple_mean <> 0 AND full_weighted <> 0 THEN 1 END) AS n_nonzero, round(avg(CASE WHEN simple_mean <> 0 AND full_weighted <> 0 THEN CASE WHEN sign(simple_mean) = sign(full_weighted) THEN 1.0 ELSE 0.0 END END), 6) AS agreement_nonzero FROM v WHERE simple_mean IS NOT NULL AND full_weighted IS NOT NULL"))
def directional_agreement(spark, sf_dir):
    return shown(stats.agreement(_variants(spark, sf_dir), "simple_mean", "full_weighted"))


@query(sql("eligible bars", f"WITH {SIGNAL}, j AS (SELECT simple_mean AS s, next_return AS t FROM s JOIN x ON s.date = x.date WHERE next_return IS NOT NULL) SELECT count(*) AS n, round(corr(s, t), 6) AS r, count(CASE WHEN s <> 0 AND t <> 0 THEN 1 END) AS n_signed, count(CASE WHEN s <> 0 AND t <> 0 AND sign(s) = sign(t) THEN 1 END) AS hits, round(count(CASE WHEN s <> 0 AND t <> 0 AND sign(s) = sign(t) THEN 1 END) / count(CASE WHEN s <> 0 AND t <> 0 THEN 1 END), 6) AS hit_rate, count(CASE WHEN s = 0 THEN 1 END) AS zero_signals, count(CASE WHEN t = 0 THEN 1 END) AS zero_targets FROM j"))
def predictive_metrics(spark, sf_dir):
    r = market.next_session(d.bars(spark, sf_dir)).select("date", "next_return")
    return shown(stats.predictive(_signal(spark, sf_dir).join(r, "date"), "simple_mean", "next_return"))


@query(sql("eligible", "SELECT CAST(g AS BIGINT) AS g, family, category, n, sources, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM (SELECT family, category, count(*) AS n, count(DISTINCT source) AS sources, GROUPING(family, category) AS g FROM eligible GROUP BY GROUPING SETS ((family), (category), (family, category))) x"))
def taxonomy_coverage(spark, sf_dir):
    return shown(reports.coverage(eligible(spark, sf_dir), "family", "category"))


@query(sql("headlines", "WITH c AS (SELECT published_date AS day, count(*) AS n FROM headlines GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(s.day AS VARCHAR) AS published_date, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.day = s.day"))
def corpus_daily_spine(spark, sf_dir):
    return shown(reports.daily_spine(d.headlines(spark, sf_dir), "published_date"))


QUALITY = """b AS (SELECT source, count(*) AS n, avg(CASE WHEN published_ts IS NULL THEN 1.0 ELSE 0.0 END) AS u, avg(abs(score)) AS m, avg(CASE WHEN relevance < 0.25 THEN 1.0 WHEN relevance IS NOT NULL THEN 0.0 END) AS t FROM headlines GROUP BY 1),
c AS (SELECT source, category FROM (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, category) AS k FROM headlines GROUP BY 1, 2) x WHERE k = 1)"""


@query(sql("headlines", f"WITH {QUALITY} SELECT b.source, n, round(u, 6) AS untimed_share, round(m, 6) AS mean_strength, round(t, 6) AS thin_share, category AS modal_category, CASE WHEN n < 20 THEN 'SKIP' WHEN u < 0.2 AND t < 0.3 THEN 'ADD' ELSE 'MARGINAL' END AS verdict FROM b JOIN c ON c.source = b.source"))
def source_quality(spark, sf_dir):
    return shown(reports.feed_verdict(reports.source_quality(d.headlines(spark, sf_dir))))


@query(sql("eligible", "WITH g AS (SELECT source, count(*) AS n, avg(score) AS m FROM eligible GROUP BY 1 HAVING count(*) >= 20) SELECT arg_max(source, m) AS highest, round(max(m), 6) AS highest_mean, arg_min(source, m) AS lowest, round(min(m), 6) AS lowest_mean FROM g"))
def corpus_extremes(spark, sf_dir):
    return shown(reports.extremes(eligible(spark, sf_dir), "source", "score"))


CONF = "c AS (SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS actual, CASE WHEN d.n_chars % 7 = 0 THEN 'toxic' WHEN d.n_chars > 900 THEN 'good' ELSE 'poor' END AS predicted, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _labels(spark, sf_dir):
    l, x = d.table(spark, sf_dir, "labels"), d.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    actual = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    predicted = F.when(F.col("n_chars") % 7 == 0, "toxic").when(F.col("n_chars") > 900, "good").otherwise("poor")
    return x.join(l, "doc_id").select("doc_id", "n_chars", actual.alias("actual"), predicted.alias("predicted"))


@query(f"""WITH {CONF}, m AS (SELECT actual, count(CASE WHEN predicted = 'good' THEN 1 END) AS good, count(CASE WHEN predicted = 'poor' THEN 1 END) AS poor, count(CASE WHEN predicted = 'toxic' THEN 1 END) AS toxic, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS r FROM c GROUP BY 1),
w AS (SELECT actual, predicted FROM (SELECT actual, predicted, row_number() OVER (PARTITION BY actual ORDER BY count(*) DESC, predicted) AS k FROM c WHERE actual <> predicted GROUP BY 1, 2) x WHERE k = 1)
SELECT m.actual, good, poor, toxic, round(r, 6) AS recall, w.predicted AS top_mistake FROM m LEFT JOIN w ON w.actual = m.actual""")
def label_confusion_matrix(spark, sf_dir):
    return shown(reports.confusion(_labels(spark, sf_dir), "actual", "predicted", ["good", "poor", "toxic"]))


@query(sql("headlines", """WITH t AS (SELECT relevance, score > 0 AS truth FROM headlines WHERE relevance IS NOT NULL AND score IS NOT NULL), g AS (SELECT unnest(range(0, 51)) AS i),
a AS (SELECT i, avg(CASE WHEN (floor(relevance / 0.01 + 1e-9) >= i) = truth THEN 1.0 ELSE 0.0 END) AS acc FROM t, g GROUP BY 1)
SELECT round(CAST(i * 0.01 AS DOUBLE), 6) AS threshold, round(acc, 6) AS accuracy, i = (SELECT i FROM a ORDER BY acc DESC, i LIMIT 1) AS is_best FROM a"""))
def threshold_sweep(spark, sf_dir):
    return shown(reports.threshold_sweep(d.headlines(spark, sf_dir), "relevance", F.col("score") > 0))


@query(sql("headlines", "SELECT CASE WHEN k <= floor(0.6 * n) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, CAST(min(published_date) AS VARCHAR) AS first_day, CAST(max(published_date) AS VARCHAR) AS last_day FROM (SELECT published_date, row_number() OVER (ORDER BY published_date, id) AS k, count(*) OVER () AS n FROM headlines) x GROUP BY 1"))
def chronological_split(spark, sf_dir):
    # the place of a row: rows of earlier days, by a window over days, and the place within its day
    h = d.headlines(spark, sf_dir)
    days = h.groupBy("published_date").agg(F.count("*").alias("c"))
    days = days.withColumns({"before": F.sum("c").over(W.orderBy("published_date")) - F.col("c"), "n": F.sum("c").over(W.partitionBy())})
    k = F.col("before") + F.row_number().over(W.partitionBy("published_date").orderBy("id"))
    rows = h.join(F.broadcast(days), "published_date").withColumn("split", F.when(k <= F.floor(F.col("n") * 0.6), "train").otherwise("test"))
    return shown(rows.groupBy("split").agg(F.count("*").alias("rows"), F.min("published_date").alias("first_day"), F.max("published_date").alias("last_day")))


@query(sql("headlines", "SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY sha256(CAST(id AS VARCHAR))) AS k FROM headlines) x WHERE k <= 15"))
def stratified_hash_sample(spark, sf_dir):
    return shown(reports.stratified_sample(d.headlines(spark, sf_dir).select("id", "category"), "category", "id"))


@query(sql("headlines", "SELECT id, round(greatest(1 - abs(abs(score) - 0.05), 1 - abs(relevance - 0.25)), 6) AS uncertainty FROM headlines WHERE score IS NOT NULL AND relevance IS NOT NULL ORDER BY greatest(1 - abs(abs(score) - 0.05), 1 - abs(relevance - 0.25)) DESC, id LIMIT 60"))
def active_learning_topn(spark, sf_dir):
    rows = d.headlines(spark, sf_dir).where("score IS NOT NULL AND relevance IS NOT NULL")
    return shown(reports.active_learning(rows, "score", "relevance", 0.25, 60, "id").select("id", "uncertainty"))


@query(sql("assigned", "SELECT family || ':' || event_ref AS group_key, count(DISTINCT source) AS source_count, count(*) AS headline_count FROM assigned WHERE event_ref IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25"))
def ranked_groups_top25(spark, sf_dir):
    g = assigned(spark, sf_dir).where("event_ref IS NOT NULL").groupBy(F.concat_ws(":", "family", "event_ref").alias("group_key")).agg(F.count_distinct("source").alias("source_count"), F.count("*").alias("headline_count"))
    return shown(g.orderBy(F.desc("source_count"), F.desc("headline_count"), "group_key").limit(25))


@query(sql("headlines", "SELECT id, category, CAST(published_date AS VARCHAR) AS published_date, round(score, 6) AS score FROM headlines WHERE coalesce(relevance, 1) >= 0.25 ORDER BY published_date DESC, id DESC LIMIT 50"))
def recent_headlines(spark, sf_dir):
    h = d.headlines(spark, sf_dir).where(F.coalesce("relevance", F.lit(1.0)) >= 0.25)
    return shown(h.orderBy(F.desc("published_date"), F.desc("id")).limit(50).select("id", "category", "published_date", "score"))


@query(sql("factors", """WITH r AS (SELECT symbol, date, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS r FROM factors), p AS (SELECT symbol AS test, count(r) / 100000.0 + avg(abs(r)) / 1000.0 AS p_value FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS rank, count(*) OVER () AS m FROM p)
SELECT test, round(p_value, 6) AS p_value, round(least(1.0, min(p_value * m / rank) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q_value FROM k"""))
def bh_fdr(spark, sf_dir):
    r = market.daily_returns(d.factors(spark, sf_dir), ["symbol"])
    p = r.groupBy(F.col("symbol").alias("test")).agg((F.count("daily_return") / 100000.0 + F.avg(F.abs("daily_return")) / 1000.0).alias("p_value"))
    return shown(stats.benjamini_hochberg(p))


@query(sql("long_bars", "SELECT round(regr_slope(close, volume), 4) AS slope, round(regr_intercept(close, volume), 4) AS intercept, round(corr(close, volume), 6) AS r FROM long_bars"))
def scatter_fit(spark, sf_dir):
    return shown(d.long_bars(spark, sf_dir).agg(F.round(F.regr_slope("close", "volume"), 4).alias("slope"), F.round(F.regr_intercept("close", "volume"), 4).alias("intercept"), F.corr("close", "volume").alias("r")))


@query(sql("long_bars factors", """WITH y AS (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS y FROM long_bars), x AS (SELECT date, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS x FROM factors WHERE symbol = '2-HIGH'), j AS (SELECT y.date, y, x FROM y JOIN x ON x.date = y.date WHERE y IS NOT NULL AND x IS NOT NULL)
SELECT CAST(date AS VARCHAR) AS date, round(y - (SELECT regr_slope(y, x) FROM j) * x, 5) AS abnormal FROM j"""))
def beta_abnormal_return(spark, sf_dir):
    y = market.daily_returns(d.long_bars(spark, sf_dir)).select("date", F.col("daily_return").alias("y"))
    x = market.daily_returns(d.factors(spark, sf_dir).where("symbol = '2-HIGH'")).select("date", F.col("daily_return").alias("x"))
    return shown(stats.beta_adjusted(y.join(x, "date").where("y IS NOT NULL AND x IS NOT NULL"), "y", "x").select("date", "abnormal"), 5)


@query(sql("long_bars", "WITH r AS (SELECT date, volume, (close / lag(close) OVER (ORDER BY date) - 1) AS r FROM long_bars), h AS (SELECT date, CASE WHEN lag(volume) OVER (ORDER BY date) > 6 THEN r ELSE 0.0 END AS s FROM r WHERE r IS NOT NULL) SELECT count(*) AS sessions, count(CASE WHEN s <> 0 THEN 1 END) AS held, round(sum(ln(1 + s)), 5) AS log_return FROM h"))
def hypothetical_long_flat(spark, sf_dir):
    r = market.daily_returns(d.long_bars(spark, sf_dir)).where("daily_return IS NOT NULL")
    s = F.when(F.lag("volume").over(W.orderBy("date")) > 6, F.col("daily_return") / 100).otherwise(0.0)
    return shown(r.withColumn("s", s).agg(F.count("*").alias("sessions"), F.count_if(F.col("s") != 0).alias("held"), F.sum(F.log1p("s")).alias("log_return")), 5)


@query("")
def correlation_tests(spark, sf_dir):
    b = d.long_bars(spark, sf_dir)
    a = stats.correlation(b, "close", "volume").withColumn("method", F.lit("pearson"))
    return shown(a.unionByName(stats.correlation(b, "close", "volume", True).withColumn("method", F.lit("spearman"))).withColumn("detectable_r", stats.detectable_r(F.col("n"))))


@query("")
def granger_lags(spark, sf_dir):
    b = market.daily_returns(d.long_bars(spark, sf_dir)).withColumn("v", F.col("volume").cast("double")).where("daily_return IS NOT NULL")
    return shown(stats.granger(b, "daily_return", "v", 1).unionByName(stats.granger(b, "daily_return", "v", 2)))


@query("")
def clustered_fixed_effects(spark, sf_dir):
    rows = eligible(spark, sf_dir).withColumn("camp", camp()).where("camp IS NOT NULL").withColumn("pro", (F.col("camp") == "a").cast("double"))
    return shown(stats.fixed_effects(rows, "score", "pro", "category", "published_date", "source"))


@query("SELECT table_name, n, newest FROM (SELECT 'events' AS table_name, count(*) AS n, CAST(max(event_id) AS VARCHAR) AS newest FROM events UNION ALL SELECT 'orders', count(*), CAST(max(o_orderkey) AS VARCHAR) FROM orders UNION ALL SELECT 'documents', count(*), CAST(max(doc_id) AS VARCHAR) FROM documents) x")
def snapshot_markers(spark, sf_dir):
    t = {"events": "event_id", "orders": "o_orderkey", "documents": "doc_id"}
    return shown(reports.snapshot_markers({k: (d.table(spark, sf_dir, k), key) for k, key in t.items()}))


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(sha256(c_custkey || '|' || c_name || '|' || c_mktsegment), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM customer")
def content_digest(spark, sf_dir):
    return shown(reports.row_digest(d.table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"]))


@query("SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS entry_id, l_returnflag AS state FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) AS k FROM lineitem) x WHERE k = 1")
def latest_audit_entry(spark, sf_dir):
    last = d.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("x"))
    return shown(last.select("order_key", F.col("x.l_linenumber").alias("entry_id"), F.col("x.l_returnflag").alias("state")))


@query(sql("long_bars", "SELECT CAST(date AS VARCHAR) AS date, 'close' AS series, round(close, 6) AS value FROM long_bars UNION ALL SELECT CAST(date AS VARCHAR), 'volume', volume FROM long_bars"))
def unpivot_external_series(spark, sf_dir):
    b = d.long_bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    return shown(b.unpivot("date", ["close", "volume"], "series", "value"))


@query(sql("headlines", """WITH b AS (SELECT id, source, round(score, 4) AS s FROM headlines WHERE id % 10 <> 3), a AS (SELECT id, source, CASE WHEN id % 10 = 4 THEN 'moved' ELSE source END AS source2, round(score, 4) AS s FROM headlines WHERE id % 10 <> 5)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.source2 <> b.source"""))
def snapshot_comparison(spark, sf_dir):
    h = d.headlines(spark, sf_dir).select("id", "source", F.round("score", 4).alias("s"))
    after = h.where("id % 10 <> 5").withColumn("source", F.when(F.col("id") % 10 == 4, "moved").otherwise(F.col("source")))
    return shown(reports.changed_rows(h.where("id % 10 <> 3"), after, "id", ["source", "s"]))


@query(sql("headlines", "SELECT CAST(min(published_date) AS VARCHAR) AS first_day, CAST(max(published_date) AS VARCHAR) AS last_day, count(*) AS n, count(score) AS scored, count(DISTINCT source) AS sources, count(CASE WHEN published_ts IS NULL THEN 1 END) AS untimed FROM headlines"))
def db_statistics(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    return shown(h.agg(F.min("published_date").alias("first_day"), F.max("published_date").alias("last_day"), F.count("*").alias("n"), F.count("score").alias("scored"), F.count_distinct("source").alias("sources"), F.count_if(F.col("published_ts").isNull()).alias("untimed")))


@query(sql("headlines", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN relevance < 0.25 AND id % 5 <> 0 THEN 'excluded' WHEN score IS NULL AND id % 34 = 0 THEN 'failed' WHEN score IS NULL THEN 'missing' WHEN score BETWEEN -0.05 AND 0.05 THEN 'explicit_neutral' ELSE 'scored_non_neutral' END AS state FROM headlines) x GROUP BY 1"""))
def audit_states(spark, sf_dir):
    state = (
        F.when((F.col("relevance") < 0.25) & (F.col("id") % 5 != 0), "excluded").when(F.col("score").isNull() & (F.col("id") % 34 == 0), "failed").when(F.col("score").isNull(), "missing")
        .when(F.col("score").between(-0.05, 0.05), "explicit_neutral").otherwise("scored_non_neutral")
    )
    return shown(d.headlines(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n")))
