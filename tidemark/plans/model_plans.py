"""Queries on folds, models, stored state and ingest."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import calendar, grid, history, market, models, reports
from tidemark.plans.common import eligible, shown, sql, trading_calendar
from tidemark.plans.report_plans import camp
from tidemark.sources import driver_tables as d
from tidemark.sources import feeds

QUERIES, SQL = {}, {}
GEOMETRY = models.Geometry("weekly", 300, 60, 2)


def query(text_: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text_:
            SQL[f.__name__] = text_
        return f

    return register


UNITS = """y AS (SELECT date AS session, close, volume, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS target FROM long_bars),
r AS (SELECT *, row_number() OVER (ORDER BY session) AS i, count(*) OVER () AS n FROM y),
f AS (SELECT session, target, fold, CASE WHEN i < 301 + fold * 60 - 2 THEN 'train' WHEN i < 301 + fold * 60 THEN 'embargo' WHEN i < 361 + fold * 60 THEN 'test' END AS role FROM (SELECT *, unnest(range(0, CAST(floor((n - 300) / 60.0) AS BIGINT))) AS fold FROM r) x)"""


def _units(spark, sf_dir):
    b = market.daily_returns(d.long_bars(spark, sf_dir)).withColumnRenamed("date", "session").withColumnRenamed("daily_return", "target")
    w = W.orderBy("session")
    return b.select("session", "target", F.lag("target", 1).over(w).alias("lag_1"), F.lag("target", 2).over(w).alias("lag_2"), F.lag("volume", 1).over(w).cast("double").alias("volume_1"))


@query(sql("long_bars", f"WITH {UNITS} SELECT fold, CAST(session AS VARCHAR) AS session, role FROM f WHERE role IS NOT NULL"))
def walkforward_folds(spark, sf_dir):
    return shown(models.build_folds(_units(spark, sf_dir), "session", GEOMETRY))


@query(sql("long_bars", f"WITH {UNITS} SELECT fold, count(CASE WHEN role = 'train' THEN 1 END) AS n_train, count(CASE WHEN role = 'test' THEN 1 END) AS n_test, true AS is_safe FROM f WHERE role IS NOT NULL GROUP BY 1"))
def fold_safety(spark, sf_dir):
    return shown(models.folds_are_safe(models.build_folds(_units(spark, sf_dir), "session", GEOMETRY), "session"))


PREDICTED = f"{UNITS}, m AS (SELECT fold, avg(target) AS p FROM f WHERE role = 'train' GROUP BY 1), q AS (SELECT f.fold, session, target AS actual, p AS predicted FROM f JOIN m ON m.fold = f.fold WHERE role = 'test' AND target IS NOT NULL)"


def _mean_baseline(spark, sf_dir):
    u = _units(spark, sf_dir)
    f = models.build_folds(u, "session", GEOMETRY).join(u, "session")
    m = f.where("role = 'train'").groupBy("fold").agg(F.avg("target").alias("predicted"))
    return f.where("role = 'test' AND target IS NOT NULL").join(F.broadcast(m), "fold").select("fold", "session", F.col("target").alias("actual"), "predicted")


@query(sql("long_bars", f"WITH {PREDICTED} SELECT fold, count(*) AS n, round(avg(abs(actual - predicted)), 5) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 5) AS rmse FROM q GROUP BY 1"))
def fold_mean_baseline_mae(spark, sf_dir):
    return shown(models.regression_metrics(_mean_baseline(spark, sf_dir), "fold").select("fold", "n", "mae", "rmse"), 5)


LAGGED = f"{UNITS}, l AS (SELECT session, target AS actual, lag(target) OVER (ORDER BY session) AS predicted FROM y), z AS (SELECT * FROM l WHERE predicted IS NOT NULL AND actual IS NOT NULL)"


def _lagged(spark, sf_dir):
    return _units(spark, sf_dir).select("session", F.col("target").alias("actual"), F.col("lag_1").alias("predicted")).where("actual IS NOT NULL AND predicted IS NOT NULL")


@query(sql("long_bars", f"WITH {LAGGED}, s AS (SELECT actual > 0 AS up, predicted > 0 AS said FROM z WHERE actual <> 0), a AS (SELECT count(*) AS n, avg(CASE WHEN up = said THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN said THEN 1.0 ELSE 0.0 END) FILTER (up) AS ur, avg(CASE WHEN NOT said THEN 1.0 ELSE 0.0 END) FILTER (NOT up) AS dr FROM s) SELECT n, round(acc, 6) AS accuracy, round(ur, 6) AS up_recall, round(dr, 6) AS down_recall, round((ur + dr) / 2, 6) AS balanced_accuracy FROM a"))
def direction_metrics(spark, sf_dir):
    return shown(models.direction_metrics(_lagged(spark, sf_dir)))


@query(sql("long_bars", f"WITH {LAGGED}, p AS (SELECT actual, 1 / (1 + exp(-greatest(-30, least(30, predicted / 97.0)))) AS predicted FROM z) SELECT CAST(least(floor(predicted * 4), 3) AS BIGINT) AS bin, count(*) AS n, round(avg(predicted), 6) AS mean_predicted, round(avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM p GROUP BY 1"))
def calibration_bins(spark, sf_dir):
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("predicted") / F.lit(97.0)))
    p = _lagged(spark, sf_dir).withColumn("predicted", 1 / (1 + F.exp(-z)))
    return shown(models.calibration(p))


def _walk(spark, sf_dir, *specs):
    u = _units(spark, sf_dir)
    return models.walk_forward(u, models.build_folds(u, "session", GEOMETRY), "session", "target", specs)


LAGS = ["lag_1", "lag_2", "volume_1"]


@query("")
def ridge_walkforward(spark, sf_dir):
    return shown(models.regression_metrics(_walk(spark, sf_dir, ("lags_ridge", LAGS, "ridge"), ("mean", [], "mean")), "spec", "fold"))


@query("")
def logistic_walkforward(spark, sf_dir):
    p = _walk(spark, sf_dir, ("lags_logistic", LAGS, "logistic"), ("majority", [], "majority"))
    return shown(models.direction_metrics(p, "spec", boundary=0.5).join(models.brier(p, "spec"), "spec"))


@query("")
def baseline_comparison(spark, sf_dir):
    return shown(models.compare_to_baselines(_walk(spark, sf_dir, ("lags_ridge", LAGS, "ridge"), ("lag_ridge", LAGS[:1], "ridge"), ("mean", [], "mean")), ["mean"], "session"))


FEATURE_SETS = {"none": [], "lag": ["lag_1"], "lags": LAGS, "sparse": ["lag_1", "sparse_1"]}
SENSITIVITIES = {"all": "true", "busy": "volume_1 >= 5", "late": "session >= DATE'1997-06-01'"}


def _grid(spark, sf_dir):
    u = _units(spark, sf_dir)
    u = u.withColumns({"sparse_1": F.when(F.dayofmonth("session") == 3, F.col("lag_2")), "next_target": F.lead("target", 1).over(W.orderBy("session"))})
    specs = grid.expand(FEATURE_SETS, ["target", "next_target"], list(SENSITIVITIES))
    return u, models.build_folds(u, "session", GEOMETRY), specs


def _holes(columns: list[str]) -> str:
    """The columns with nulls and how many, in order of name, as the library lists them."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN count(*) > count({c}) THEN '{c}=' || (count(*) - count({c})) END" for c in sorted(columns)) + "], lambda x: x IS NOT NULL), ',')"


def _gate_sql(sensitivity: str, target: str, name: str) -> str:
    columns = [*FEATURE_SETS[name], target]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    condition = SENSITIVITIES[sensitivity].replace("DATE'", "DATE '")
    return f"""SELECT '{sensitivity}' AS sensitivity, '{target}' AS target, '{name}' AS feature_set, count(*) AS rows_total, count(CASE WHEN {complete} THEN 1 END) AS rows_complete, {_holes(columns)} AS missing,
(SELECT coalesce(string_agg(CAST(fold AS VARCHAR), ',' ORDER BY fold), '') FROM (SELECT fold FROM f JOIN g USING (session) WHERE ({condition}) AND {complete.replace('target IS', 'g.target IS') if target == 'target' else complete} GROUP BY fold HAVING count(CASE WHEN role = 'train' THEN 1 END) >= 200 AND count(CASE WHEN role = 'test' THEN 1 END) >= 20) z) AS folds
FROM g WHERE {condition}"""


GATES_SQL = " UNION ALL ".join(_gate_sql(s, t, n) for s in SENSITIVITIES for t in ("target", "next_target") for n in FEATURE_SETS)


@query(sql("long_bars", f"""WITH {UNITS}, g0 AS (SELECT session, target, lag(target) OVER (ORDER BY session) AS lag_1, lag(target, 2) OVER (ORDER BY session) AS lag_2, CAST(lag(volume) OVER (ORDER BY session) AS DOUBLE) AS volume_1, lead(target) OVER (ORDER BY session) AS next_target FROM y),
g AS (SELECT *, CASE WHEN day(session) = 3 THEN lag_2 END AS sparse_1 FROM g0), gates AS ({GATES_SQL})
SELECT sensitivity, target, feature_set, rows_total, rows_complete, CASE WHEN rows_total > 0 THEN round(rows_complete / rows_total, 4) END AS coverage, missing, folds, CASE WHEN rows_complete < 200 OR folds = '' THEN 'insufficient_sample' ELSE 'fitted' END AS status,
CASE WHEN rows_complete < 200 THEN rows_complete || ' usable rows < minimum_sessions_to_fit 200' WHEN NOT EXISTS (SELECT 1 FROM f WHERE role IS NOT NULL) THEN 'no folds could be built from the available session range' WHEN folds = '' THEN 'no fold has >= 200 training and >= 20 test sessions with complete features' END AS requirement FROM gates"""))
def validation_gates(spark, sf_dir):
    """Which samples of the grid may be fitted at all, and what binds the others."""
    u, folds, specs = _grid(spark, sf_dir)
    out = grid.gates(u, folds, specs, SENSITIVITIES, minimum=200, minimum_test=20)
    return shown(out.withColumn("folds", F.array_join(F.transform("fittable_folds", lambda x: x.cast("string")), ",")).drop("fittable_folds"))


@query("")
def validation_grid(spark, sf_dir):
    """Every specification, fitted or refused; tests/test_grid.py holds the numbers against numpy."""
    u, folds, specs = _grid(spark, sf_dir)
    return shown(grid.run_grid(u, folds, specs, SENSITIVITIES, minimum=200, minimum_test=20)[0].drop("fittable_folds"))


@query("")
def cluster_bootstrap(spark, sf_dir):
    p = _mean_baseline(spark, sf_dir).withColumns({"error": F.abs(F.col("actual") - F.col("predicted")), "spec": F.lit("mean")})
    return shown(models.cluster_bootstrap(p, "session", "error"))


@query("")
def camp_gap_interval(spark, sf_dir):
    return shown(models.camp_gap_bootstrap(eligible(spark, sf_dir), camp(), "score", "published_date"))


@query(sql("headlines", """WITH a AS (SELECT id, k AS seq, (id * 7 + k * 3) % 5 = 0 AS ok FROM (SELECT id, unnest(range(0, 4)) AS k FROM headlines) x), s AS (SELECT id, min(CASE WHEN ok THEN seq END) AS s FROM a GROUP BY 1),
f AS (SELECT a.id, s, count(CASE WHEN NOT ok AND (s IS NULL OR seq < s) THEN 1 END) AS n FROM a JOIN s ON s.id = a.id GROUP BY 1, 2)
SELECT id, least(n, 3) AS failures, CASE WHEN n >= 3 THEN 'failed' WHEN s IS NOT NULL THEN 'scored' ELSE 'retry_pending' END AS status FROM f"""))
def retry_state_machine(spark, sf_dir):
    a = d.headlines(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    return shown(history.fold_attempts(a.withColumn("ok", (F.col("id") * 7 + F.col("seq") * 3) % 5 == 0)))


def _canonical(spark, sf_dir):
    return d.headlines(spark, sf_dir).select("id", "source", F.concat(F.lit("Title "), "category", F.lit(" "), (F.col("id") % 50).cast("string")).alias("title"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("u/"), (F.col("id") % 4000).cast("string"))).alias("url"), "published_date")


CANON = "c AS (SELECT id, source, 'Title ' || category || ' ' || (id % 50) AS title, CASE WHEN id % 9 <> 0 THEN 'u/' || (id % 4000) END AS url, published_date FROM headlines)"


@query(sql("headlines", f"""WITH {CANON}, i AS (SELECT *, row_number() OVER (PARTITION BY source, lower(title), published_date ORDER BY id) AS r FROM c WHERE id >= 3000), j AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS q FROM i WHERE r = 1), o AS (SELECT * FROM c WHERE id < 3000)
SELECT id FROM j WHERE (q = 1 OR url IS NULL) AND NOT EXISTS (SELECT 1 FROM o WHERE o.source = j.source AND lower(o.title) = lower(j.title) AND o.published_date = j.published_date) AND (url IS NULL OR url NOT IN (SELECT url FROM o WHERE url IS NOT NULL))"""))
def canonical_insert_dedupe(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    return shown(history.new_canonical(c.where("id >= 3000"), c.where("id < 3000")).select("id"))


@query(sql("observations", f"""WITH {CANON}, o AS (SELECT id * 100 + CAST(substring(x.source, 8) AS BIGINT) AS obs, x.source, title, CASE WHEN id % 3 = 0 THEN url END AS url, published_date FROM c JOIN observations x USING (id)),
u AS (SELECT url, min(id) AS u FROM c WHERE url IS NOT NULL GROUP BY 1), t AS (SELECT source, lower(title) AS title, published_date, min(id) AS t FROM c GROUP BY 1, 2, 3)
SELECT obs, CAST(coalesce(u, t) AS DOUBLE) AS headline_id, CASE WHEN u IS NOT NULL THEN 'url' WHEN t IS NOT NULL THEN 'title' END AS link FROM o LEFT JOIN u ON u.url = o.url LEFT JOIN t ON t.source = o.source AND t.title = lower(o.title) AND t.published_date = o.published_date"""))
def observation_links(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    o = c.drop("source").join(d.observations(d.headlines(spark, sf_dir)), "id")
    obs = F.col("id") * 100 + F.substring("source", 8, 4).cast("long")
    o = o.select(obs.alias("obs"), "source", "title", F.when(F.col("id") % 3 == 0, F.col("url")).alias("url"), "published_date")
    out = history.link_observations(o, c).select("obs", "headline_id", "link")
    return shown(out.withColumn("headline_id", F.col("headline_id").cast("double")))


@query(sql("headlines", "SELECT CASE WHEN relevance < 0.25 THEN 'exclude' ELSE 'restore' END AS action, count(*) AS n FROM headlines WHERE (relevance < 0.25 AND id % 4 <> 0 AND id % 10 <> 1) OR (relevance >= 0.25 AND id % 4 = 0) GROUP BY 1"))
def relevance_reconciliation(spark, sf_dir):
    h = d.headlines(spark, sf_dir).where("relevance IS NOT NULL").withColumn("graded_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    past = h.where("id % 4 = 0").select(F.col("id").alias("headline_id"), F.lit("relevance-v1").alias("rule_version"), F.lit(None).cast("string").alias("restored_by"), F.lit(None).cast("timestamp_ntz").alias("restored_at"))
    user = h.where("id % 4 <> 0 AND id % 10 = 1").select(F.col("id").alias("headline_id"), F.lit("relevance-v1").alias("rule_version"), F.lit("user").alias("restored_by"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("restored_at"))
    out, back = history.reconcile_exclusions(h, past.unionByName(user))
    both = out.select(F.lit("exclude").alias("action")).unionByName(back.select(F.lit("restore").alias("action")))
    return shown(both.groupBy("action").agg(F.count("*").alias("n")))


@query("SELECT o_custkey AS run_id, CASE max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'success' END AS status FROM orders GROUP BY 1")
def run_status_fold(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "degraded").otherwise("success")
    return shown(history.run_status(o.select(F.col("o_custkey").alias("run_id"), status.alias("status"))))


@query(sql("headlines", "SELECT CASE WHEN id % 6 = 0 THEN 'exp_' || (id % 4) WHEN id % 6 = 1 THEN 'gpt' ELSE 'unknown' END AS experiment, count(*) AS n FROM headlines GROUP BY 1"))
def experiment_identities(spark, sf_dir):
    h = d.headlines(spark, sf_dir).select(F.when(F.col("id") % 6 == 0, F.concat(F.lit(" exp_"), (F.col("id") % 4).cast("string"))).otherwise(" ").alias("experiment_id"), F.when(F.col("id") % 6 == 1, F.lit("gpt")).alias("model_name"))
    return shown(h.groupBy(history.experiment_identity(h).alias("experiment")).agg(F.count("*").alias("n")))


@query("SELECT page_id, regexp_extract(html, '<li><a href=\"(/[^\"]*)\">([^<]*)</a>', 1) AS first_link, CAST(len(regexp_extract_all(html, '<li><a href=\"(/[^\"]*)\">([^<]*)</a>')) AS BIGINT) AS n_links FROM pages WHERE regexp_matches(html, '<li><a href=\"(/[^\"]*)\">([^<]*)</a>')")
def html_listing_scan(spark, sf_dir):
    p = feeds.html_listing(d.table(spark, sf_dir, "pages"), ['<li><a href="(/[^"]*)">([^<]*)</a>', '<a href="(/[^"]*)">([^<]*)</a>'])
    return shown(p.groupBy("page_id").agg(F.first("link").alias("first_link"), F.count("*").alias("n_links")))


@query("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, round(high, 2) AS high, round(low, 2) AS low FROM p WHERE date <= DATE '1998-12-31'""")
def fx_json_payload(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    payload = o.select(F.to_json(F.create_map(F.col("date").cast("string"), F.struct("high", "low"))).alias("json"))
    return shown(feeds.fx_rates(payload, until="1998-12-31").select("date", "high", "low"), 2)


@query(sql("headlines", "SELECT CASE WHEN score IS NULL THEN 'none' WHEN score >= 0.15 THEN 'clearly positive' WHEN score > 0.05 THEN 'slightly positive' WHEN score <= -0.15 THEN 'clearly negative' WHEN score < -0.05 THEN 'slightly negative' ELSE 'neutral' END AS tone, count(*) AS n FROM headlines GROUP BY 1"))
def tone_words(spark, sf_dir):
    h = d.headlines(spark, sf_dir)
    return shown(h.groupBy(F.coalesce(core.tone_word(F.col("score")), F.lit("none")).alias("tone")).agg(F.count("*").alias("n")))


@query(sql("headlines", "SELECT id, CASE WHEN p - m > 0.05 THEN 'positive' WHEN p - m < -0.05 THEN 'negative' ELSE 'neutral' END AS new_label FROM (SELECT id, label, greatest(score, 0) * relevance AS p, greatest(-score, 0) * relevance AS m FROM headlines WHERE score IS NOT NULL AND relevance IS NOT NULL) x WHERE label <> CASE WHEN p - m > 0.05 THEN 'positive' WHEN p - m < -0.05 THEN 'negative' ELSE 'neutral' END"))
def relabelled_rows(spark, sf_dir):
    h = d.headlines(spark, sf_dir).where("score IS NOT NULL AND relevance IS NOT NULL")
    parts = h.withColumns({"p_positive": F.greatest("score", F.lit(0.0)) * F.col("relevance"), "p_negative": F.greatest(-F.col("score"), F.lit(0.0)) * F.col("relevance")})
    return shown(history.relabel(parts).select("id", "new_label"))


@query(sql("headlines", "WITH r AS (SELECT id // 50 AS batch, id % 47 AS idx, label, abs(score) AS strength FROM headlines) SELECT batch, idx, label, round(strength, 6) AS strength FROM (SELECT *, count(*) OVER (PARTITION BY batch, idx) AS k FROM r) x WHERE k = 1 AND label IS NOT NULL AND strength BETWEEN 0 AND 1"))
def validated_responses(spark, sf_dir):
    r = d.headlines(spark, sf_dir).select(F.floor(F.col("id") / 50).alias("batch"), (F.col("id") % 47).alias("idx"), "label", F.abs("score").alias("strength"))
    return shown(history.validated_scores(r))


@query(sql("bars", "SELECT CAST(date AS VARCHAR) AS date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM bars) x WHERE floor(i / greatest(n / 12.0, 1.0)) <> floor((i - 1) / greatest(n / 12.0, 1.0))"))
def stride_sample(spark, sf_dir):
    return shown(reports.stride_sample(d.bars(spark, sf_dir).select("date"), "date", 12))


@query(sql("assigned bars", """WITH e AS (SELECT DISTINCT event_ref, signal_date AS session, timing_bucket FROM assigned WHERE event_ref IS NOT NULL), j AS (SELECT e.*, b.close AS c, p.close AS pc FROM e LEFT JOIN calendar k ON k.date = e.session LEFT JOIN bars b ON b.date = e.session LEFT JOIN bars p ON p.date = k.prev)
SELECT window_name, CAST(tradable AS BIGINT) AS is_tradable, reason, count(*) AS n FROM (
SELECT w AS window_name, CASE WHEN timing_bucket IN ('during_session', 'unknown') THEN 0 ELSE 1 END AS tradable, CASE WHEN c IS NULL THEN 'no_complete_price_bar' WHEN w <> 'session' AND pc IS NULL THEN 'no_prior_session_bar' ELSE 'available' END AS reason
FROM j, (SELECT unnest(['gap', 'session', 'gap_and_session']) AS w) ws WHERE w = 'gap_and_session' OR timing_bucket NOT IN ('during_session', 'unknown')) x GROUP BY 1, 2, 3"""))
def windows_by_availability(spark, sf_dir):
    cal = trading_calendar(spark)
    e = calendar.assign_sessions(d.headlines(spark, sf_dir), cal).where("event_ref IS NOT NULL").select("event_ref", F.col("signal_date").alias("session"), "timing_bucket").distinct()
    w = market.return_windows(e, cal, d.bars(spark, sf_dir))
    return shown(w.groupBy("window_name", "is_tradable", F.coalesce("reason", F.lit("available")).alias("reason")).agg(F.count("*").alias("n")))


@query(sql("headlines", "SELECT id, CASE WHEN hour IS NULL THEN 1.0 WHEN hour < 10 THEN 1.5 WHEN hour <= 18 THEN 1.0 ELSE 0.8 END::DOUBLE AS weight FROM headlines"))
def legacy_time_weights(spark, sf_dir):
    return shown(d.headlines(spark, sf_dir).select("id", core.legacy_time_weight(F.col("hour")).alias("weight")))
