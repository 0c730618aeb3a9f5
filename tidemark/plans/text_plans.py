"""Queries on text rules, pairs, events, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import core, text
from tidemark.operators import calendar, events, market, pairs
from tidemark.plans.common import assigned, shown, sql, trading_calendar
from tidemark.sources import driver_tables as d
from tidemark.sources.shared import written

QUERIES, SQL = {}, {}
#: Floor of the similarity of whole texts in pair joins.
SIMILAR = 0.6
RULES = {"alpha": ["thand", "andth"], "beta": ["ver", "und"], "gamma": ["tion", "ment"], "delta": ["que", "los"]}
HARD, STRONG, SOFT, KEY = ["zzz", "äöü", "xch"], ["the and", "und"], ["stst", "ndnd"], ["er", "que", "en"]
STOP = ["that", "with", "from", "this"]
ENTITIES = [("issuer", "T1", ["the", "der"]), ("macro", "M1", ["tion", "que"]), ("agency", "A1", ["and", "las"]), ("instrument", "I1", ["is"])]
FOLD_SQL = "lower(translate(title, 'ıİşŞğĞçÇöÖüÜâÂîÎûÛ', 'iIsSgGcCoOuUaAiIuU'))"
TITLES = "titles AS (SELECT doc_id AS id, source, text AS title FROM documents), folded AS (SELECT *, trim(regexp_replace(" + FOLD_SQL + ", '\\s+', ' ', 'g')) AS f FROM titles)"
TOKENS = "tok AS (SELECT id, source, f, list_distinct(list_filter(regexp_extract_all(f, '[a-z0-9]+'), lambda t: length(t) >= 4 AND t NOT IN ('that', 'with', 'from', 'this'))) AS tokens FROM folded)"


def query(text_: str):
    def register(f):
        QUERIES[f.__name__] = f
        if text_:
            SQL[f.__name__] = text_
        return f

    return register


def _folded(spark, sf_dir):
    return d.titles(spark, sf_dir).withColumn("f", text.fold(F.col("title")))


def _tokens(spark, sf_dir):
    return _folded(spark, sf_dir).withColumn("tokens", text.tokens(F.col("f"), 4, STOP))


def _case(rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(f, '{t}')" for t in terms) + f" THEN '{c}'" for c, terms in rules.items()) + " ELSE 'other' END"


def _has(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(f, '{t}')" for t in terms) + ")"


@query(f"WITH {TITLES} SELECT id, f AS folded FROM folded")
def fold_text(spark, sf_dir):
    return shown(_folded(spark, sf_dir).select("id", F.col("f").alias("folded")))


@query(f"WITH {TITLES}, {TOKENS} SELECT id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM tok")
def title_tokens(spark, sf_dir):
    return shown(_tokens(spark, sf_dir).select("id", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("tokens"), " ").alias("tokens")))


@query(f"WITH {TITLES} SELECT id, {_case(RULES)} AS category FROM folded")
def category_first_match(spark, sf_dir):
    return shown(_folded(spark, sf_dir).select("id", text.first_category(F.col("f"), RULES).alias("category")))


@query(f"WITH {TITLES} SELECT CASE WHEN {_has(HARD)} THEN 'hard_blocklist' WHEN {_has(STRONG)} THEN 'relevant' WHEN {_has(SOFT)} THEN 'soft_blocklist' WHEN {_has(KEY)} THEN 'relevant' ELSE 'no_keyword' END AS rule, count(*) AS n FROM folded GROUP BY 1")
def relevance_tiers(spark, sf_dir):
    rule = F.coalesce(text.relevance_rule(F.col("f"), HARD, STRONG, SOFT, KEY), F.lit("relevant"))
    return shown(_folded(spark, sf_dir).groupBy(rule.alias("rule")).agg(F.count("*").alias("n")))


@query(f"WITH {TITLES} SELECT id, {_has(SOFT)} AS blocked, {_has(STRONG)} AS overridden FROM folded WHERE {_has(SOFT)} AND {_has(STRONG)}")
def blocklist_override_edges(spark, sf_dir):
    has = lambda terms: text.first_term(F.col("f"), terms).isNotNull()
    return shown(_folded(spark, sf_dir).select("id", has(SOFT).alias("blocked"), has(STRONG).alias("overridden")).where("blocked AND overridden"))


FAMILY_SQL = f"""WITH {TITLES}, c AS (SELECT *, {_case(RULES)} AS category, contains(f, 'thin') AS recap, CASE WHEN contains(f, 'onst') THEN 'onst' WHEN contains(f, 'ation') THEN 'ation' END AS n, CASE WHEN contains(f, 'ing') THEN 'ing' END AS b, CASE WHEN contains(f, 'ed') THEN 'ed' END AS k FROM folded)
SELECT id, CASE WHEN recap THEN 'market_recap' WHEN n IS NOT NULL THEN 'market_narrative' WHEN category = 'gamma' AND b IS NOT NULL THEN 'banks' WHEN category = 'gamma' AND k IS NOT NULL THEN 'companies' WHEN category = 'alpha' THEN 'macro' WHEN category = 'beta' THEN 'rates' ELSE 'other' END AS family,
CASE WHEN recap THEN 'recap' WHEN n IS NOT NULL THEN 'narrative' WHEN category = 'gamma' AND b IS NOT NULL THEN 'bank_term' WHEN category = 'gamma' AND k IS NOT NULL THEN 'company_term' WHEN category IN ('alpha', 'beta') THEN 'category' ELSE 'fallback' END AS rule,
NOT recap AND (CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN category = 'gamma' AND b IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN category = 'gamma' AND k IS NOT NULL THEN 1 ELSE 0 END) > 1 AS ambiguous FROM c"""


@query(FAMILY_SQL)
def family_assignment(spark, sf_dir):
    f = F.col("f")
    recap = text.market_recap(f, ["thin"], [], []).getField("is_recap")
    fam = text.family(f, text.first_category(f, RULES), recap, {"alpha": "macro", "beta": "rates"}, ["onst", "ation"], ["ing"], "gamma", ["ed"])
    return shown(_folded(spark, sf_dir).withColumn("x", fam).select("id", "x.family", "x.rule", "x.ambiguous"))


@query(f"""WITH {TITLES}, r AS (SELECT id, contains(f, 'lic') AS ex, contains(f, 'thin') AS term, regexp_matches(f, '^(in|on|at) ') AS frame FROM folded)
SELECT CASE WHEN ex THEN 'exempt' WHEN term THEN 'term:thin' WHEN frame THEN 'frame' ELSE 'none' END AS rule, CAST(CASE WHEN ex THEN 0.0 WHEN term THEN 0.9 WHEN frame THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence, count(*) AS n FROM r GROUP BY 1, 2""")
def market_recap_rules(spark, sf_dir):
    x = text.market_recap(F.col("f"), ["thin"], ["^(in|on|at) "], ["lic"])
    return shown(_folded(spark, sf_dir).withColumn("x", x).groupBy("x.rule", "x.confidence").agg(F.count("*").alias("n")))


@query(f"""WITH {TITLES}, e AS (SELECT id, list_filter([CASE WHEN regexp_matches(f, '(^|[^a-z0-9])(the|der)($|[^a-z0-9])') THEN '0issuer:T1' END, CASE WHEN regexp_matches(f, '(^|[^a-z0-9])(and|las)($|[^a-z0-9])') THEN '1agency:A1' END,
CASE WHEN regexp_matches(f, '(^|[^a-z0-9])(tion|que)($|[^a-z0-9])') THEN '2macro:M1' END, CASE WHEN regexp_matches(f, '(^|[^a-z0-9])is($|[^a-z0-9])') THEN '3instrument:I1' END], lambda x: x IS NOT NULL) AS x FROM folded)
SELECT id, CAST(len(x) AS BIGINT) AS n_entities, substring(x[1], 2) AS primary_entity FROM e""")
def entity_extraction(spark, sf_dir):
    e = F.get(text.entities(F.col("f"), ENTITIES), F.lit(0))
    out = _folded(spark, sf_dir).withColumn("x", text.entities(F.col("f"), ENTITIES))
    return shown(out.select("id", F.size("x").alias("n_entities"), F.when(F.size("x") > 0, F.concat_ws(":", F.get("x", F.lit(0))["entity_type"], F.get("x", F.lit(0))["entity_id"])).alias("primary_entity")))


PAIRS_SQL = f"""WITH {TITLES}, {TOKENS}, x AS (SELECT DISTINCT id, unnest(tokens) AS t FROM tok), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT a, b, shared, round(shared / (len(u.tokens) + len(v.tokens) - shared), 6) AS jaccard FROM p JOIN tok u ON u.id = a JOIN tok v ON v.id = b WHERE shared / (len(u.tokens) + len(v.tokens) - shared) >= {SIMILAR}"""


@query(PAIRS_SQL)
def token_jaccard_pairs(spark, sf_dir):
    t = _tokens(spark, sf_dir).select("id", "tokens")
    return shown(pairs.overlap_pairs(t, t, 4, least_jaccard=SIMILAR).where("a < b"))


@query(f"""WITH {TITLES}, {TOKENS}, x AS (SELECT id, source, unnest(tokens) AS t FROM tok), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.source = b.source AND a.id <> b.id GROUP BY 1, 2),
j AS (SELECT a, b, shared / (len(u.tokens) + len(v.tokens) - shared) AS jaccard FROM p JOIN tok u ON u.id = a JOIN tok v ON v.id = b)
SELECT a AS id, b AS nearest, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS r FROM j WHERE jaccard >= {SIMILAR}) y WHERE r = 1""")
def nearest_neighbour_in_bucket(spark, sf_dir):
    return shown(pairs.nearest_in_bucket(_tokens(spark, sf_dir), ["source"], SIMILAR))


@query("")
def greedy_pairs(spark, sf_dir):
    t, short = _tokens(spark, sf_dir), F.length("source") <= 4  # two camps of sources
    return shown(pairs.greedy_class_matching(*pairs.overlap_links(t.where(short), t.where(~short), 4, least_jaccard=SIMILAR)))


def _clustered(spark, sf_dir):
    h = assigned(spark, sf_dir)
    docs = written(_tokens(spark, sf_dir).select(F.col("id").alias("text"), "tokens", F.transform(text.entities(F.col("f"), ENTITIES), lambda e: e["entity_id"]).alias("entities")))
    n = d.table(spark, sf_dir, "documents").count()
    rows = h.withColumn("text", F.col("id") % n).join(docs.drop("tokens"), "text").withColumnRenamed("published_ts", "moment")
    rows = written(rows.select("id", "family", "moment", "signal_date", "timing_bucket", "source", "score", "is_recap", "text", "entities"))
    return events.cluster_events(rows, texts=docs)


@query("")
def candidate_event_groups(spark, sf_dir):
    return shown(_clustered(spark, sf_dir).select("id", "group_key", "similarity"))


@query("")
def event_briefs(spark, sf_dir):
    m = written(_clustered(spark, sf_dir))
    g = events.summarise_events(m).join(events.event_timing(m).select("group_key", "timing_conflict"), "group_key")
    return shown(events.briefs(g, m))


EVENT_GROUPS = "g0 AS (SELECT *, family || ':' || event_ref AS group_key FROM assigned WHERE event_ref IS NOT NULL)"


def _groups(spark, sf_dir):
    return assigned(spark, sf_dir).where("event_ref IS NOT NULL").withColumns({"group_key": F.concat_ws(":", "family", "event_ref"), "moment": F.col("published_ts")})


@query(sql("assigned", f"""WITH {EVENT_GROUPS}, src AS (SELECT group_key, CASE WHEN count(m) >= 2 THEN stddev_pop(m) END AS x FROM (SELECT group_key, source, avg(score) AS m FROM g0 GROUP BY 1, 2) y GROUP BY 1)
SELECT g0.group_key, min(id) AS first_id, count(*) AS headline_count, count(DISTINCT source) AS source_count, round(avg(score), 6) AS mean_sentiment, round(median(score), 6) AS median_sentiment, CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 6) END AS dispersion,
count(CASE WHEN score >= 0.5 THEN 1 END) AS strong_positive, count(CASE WHEN score <= -0.5 THEN 1 END) AS strong_negative, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(CASE WHEN published_ts IS NULL THEN 1 END) AS untimed, round(max(x), 6) AS cross_source_std
FROM g0 JOIN src ON src.group_key = g0.group_key GROUP BY 1"""))
def event_summaries(spark, sf_dir):
    return shown(events.summarise_events(_groups(spark, sf_dir)).select("group_key", "first_id", "headline_count", "source_count", "mean_sentiment", "median_sentiment", "dispersion", "strong_positive", "strong_negative", "sources", "untimed", "cross_source_std"))


@query(sql("assigned", f"""WITH {EVENT_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY signal_date DESC, CASE timing_bucket WHEN 'during_session' THEN 0 WHEN 'unknown' THEN 1 WHEN 'weekend_or_holiday' THEN 2 WHEN 'post_close' THEN 3 ELSE 4 END, id) AS k FROM g0),
c AS (SELECT group_key, count(DISTINCT signal_date) > 1 AS timing_conflict FROM g0 GROUP BY 1)
SELECT r.group_key, CAST(signal_date AS VARCHAR) AS first_reactable_session, timing_bucket AS governing_bucket, id AS governing_id, timing_conflict FROM r JOIN c ON c.group_key = r.group_key WHERE k = 1"""))
def event_governing_timing(spark, sf_dir):
    return shown(events.event_timing(_groups(spark, sf_dir)))


@query(sql("assigned", f"""WITH {EVENT_GROUPS}, s AS (SELECT group_key, min(published_ts) AS first_seen, CASE WHEN min(id) % 4 <> 0 THEN min(event_ref) % 5 END AS entity FROM g0 GROUP BY 1),
n AS (SELECT *, CASE WHEN entity IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY entity ORDER BY first_seen NULLS FIRST, group_key) - 1 END AS prior_groups FROM s)
SELECT group_key, prior_groups, round(1.0 / (1 + prior_groups), 6) AS novelty FROM n"""))
def novelty_running_count(spark, sf_dir):
    s = _groups(spark, sf_dir).groupBy("group_key").agg(F.min("published_ts").alias("first_seen"), F.when(F.min("id") % 4 != 0, F.min("event_ref") % 5).alias("primary_entity"))
    return shown(events.novelty(s).select("group_key", "prior_groups", "novelty"))


UNITS = f"""{EVENT_GROUPS}, t AS (SELECT b.date, (b.close / p.close - 1) * 100 AS y FROM bars b JOIN calendar c ON c.date = b.date JOIN bars p ON p.date = c.prev),
e AS (SELECT group_key, signal_date AS session, family, avg(score) AS tone, avg(relevance) AS rel, count(DISTINCT source) AS breadth FROM g0 GROUP BY 1, 2, 3),
j AS (SELECT e.*, y AS target FROM e LEFT JOIN t ON t.date = e.session)"""


def _unit_rows(spark, sf_dir):
    e = _groups(spark, sf_dir).groupBy("group_key", F.col("signal_date").alias("session"), "family").agg(F.avg("score").alias("tone"), F.avg("relevance").alias("rel"), F.count_distinct("source").alias("breadth"))
    t = market.market_return_series(trading_calendar(spark), d.bars(spark, sf_dir)).select(F.col("date").alias("session"), F.col("market_return").alias("target"))
    return e.join(t, "session", "left")


UNITS_OUT = """u AS (SELECT session, max(target) AS target, count(*) AS n_events, avg(tone) AS mt, sum(tone * breadth) / sum(CASE WHEN tone IS NOT NULL THEN breadth END) AS wt, avg(rel) AS mr, sum(rel * breadth) / sum(CASE WHEN rel IS NOT NULL THEN breadth END) AS wr FROM j GROUP BY 1),
f AS (SELECT session, family AS dominant_family FROM (SELECT session, family, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, family) AS k FROM j GROUP BY 1, 2) y WHERE k = 1)"""


@query(sql("assigned bars", f"""WITH {UNITS}, {UNITS_OUT} SELECT CAST(u.session AS VARCHAR) AS session, round(target, 6) AS target, n_events, round(mt, 6) AS mean_tone, round(wt, 6) AS weighted_tone, round(mr, 6) AS mean_rel, round(wr, 6) AS weighted_rel, dominant_family FROM u JOIN f ON f.session = u.session"""))
def session_units(spark, sf_dir):
    return shown(events.session_units(_unit_rows(spark, sf_dir), "session", "target", ["tone", "rel"]))


@query(sql("assigned bars", f"""WITH {UNITS}, {UNITS_OUT} SELECT CAST(session AS VARCHAR) AS session, round(last_value(target IGNORE NULLS) OVER w, 6) AS prev_target, CAST(sign(last_value(target IGNORE NULLS) OVER w) AS DOUBLE) AS prev_sign FROM u WINDOW w AS (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def prev_target_carry(spark, sf_dir):
    return shown(events.attach_lagged(events.session_units(_unit_rows(spark, sf_dir), "session", "target", ["tone", "rel"]), "session").select("session", "prev_target", "prev_sign"))


@query(sql("assigned bars", f"WITH {UNITS} SELECT count(*) AS event_rows, count(DISTINCT session) AS sessions, count(DISTINCT CASE WHEN target IS NOT NULL THEN session END) AS outcomes, round(count(*) / count(DISTINCT session), 6) AS duplication FROM j"))
def unit_counts(spark, sf_dir):
    return shown(events.unit_counts(_unit_rows(spark, sf_dir), "session", "target"))


@query(sql("assigned bars", f"""WITH {UNITS} SELECT family, count(*) AS n, count(DISTINCT session) AS sessions, count(target) AS with_target, count(*) - count(target) AS blocked FROM j GROUP BY 1"""))
def dataset_coverage(spark, sf_dir):
    return shown(_unit_rows(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"), F.count("target").alias("with_target"), (F.count("*") - F.count("target")).alias("blocked")))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def html_title_scan(spark, sf_dir):
    p = d.table(spark, sf_dir, "pages")
    return shown(p.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.char_length("html").alias("n_chars")))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) x WHERE k = 1")
def conversation_last_turn(spark, sf_dir):
    c = d.table(spark, sf_dir, "conversations")
    return shown(c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("x")).select("conv_id", "x.*"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return shown(d.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")))


@query("SELECT event_id, sha256('[\"' || user_id || '\",\"' || event_type || '\",\"' || event_id || '\"]') AS observation_key FROM events")
def observation_keys_sha256(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    return shown(e.select("event_id", F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in ("user_id", "event_type", "event_id")])), 256).alias("observation_key")))
