import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import indicators, signals

SCHEMA = "id int, signal_date date, source string, family string, category string, score double, label string, relevance double, hour int, event_ref long, is_recap int, is_ambiguous int, timing_bucket string"
DAY = date(2024, 1, 2)


def row(i, score, source="a", relevance=None, hour=None, day=DAY, family="f", label=None):
    return (i, day, source, family, "c", score, label, relevance, hour, None, 0, 0, "unknown")


def test_variants_by_hand(spark):
    rows = spark.createDataFrame([row(1, 0.5, relevance=0.8, hour=9, label="positive"), row(2, -0.02, "b", relevance=0.4, hour=20, label="neutral"), row(3, None)], SCHEMA)
    r = signals.signal_variants(rows, "signal_date").first()
    assert math.isclose(r["simple_mean"], 0.24) and r["headline_count"] == 2 and r["excluded_incomplete_score_count"] == 1
    assert math.isclose(r["relevance_weighted"], (0.5 * 0.8 - 0.02 * 0.4) / 1.2)
    w = [0.8 * 0.5 * 1.5, 0.4 * 0.1 * 0.8]
    assert math.isclose(r["full_weighted"], (0.5 * w[0] - 0.02 * w[1]) / sum(w))
    assert r["source_count"] == 2 and r["event_count"] == 0 and math.isclose(r["dispersion"], 0.26)


def test_zero_weights_are_null(spark):
    r = signals.signal_variants(spark.createDataFrame([row(1, 0.5, relevance=0.0)], SCHEMA), "signal_date").first()
    assert r["relevance_weighted"] is None and r["full_weighted"] is None and r["simple_mean"] == 0.5 and r["dispersion"] == 0.0


def test_nan_is_missing(spark):
    r = signals.signal_variants(spark.createDataFrame([row(1, float("nan")), row(2, float("inf"))], SCHEMA), "signal_date").first()
    assert r["headline_count"] == 0 and r["simple_mean"] is None and r["positive_share"] is None


def test_family_signal_single_row_and_breadth(spark):
    rows = spark.createDataFrame([row(1, 0.3)], SCHEMA)
    seen = spark.createDataFrame([(1, "a"), (1, "b"), (1, "")], "id int, source string")
    r = signals.family_signals(rows, seen, "signal_date", "family").first()
    assert r["sentiment_std"] is None and r["source_count"] == 2 and r["sample_sufficiency"] == "thin"


def series(spark, values):
    rows = [row(i, v, day=DAY + timedelta(days=i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def tone(spark, values):
    got = indicators.abnormal_tone(series(spark, values)).where("scope = 'family'").orderBy("signal_date").collect()
    return [(r["prior_n"], r["prior_mean"], r["z_score"], r["percentile"]) for r in got]


def test_four_priors_are_too_few(spark):
    got = tone(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    assert got[4] == (4, None, None, None) and got[5][0] == 5 and math.isclose(got[5][1], 0.3) and got[5][3] == 1.0


def test_constant_history(spark):
    got = tone(spark, [0.1] * 6 + [0.4])
    assert got[5][2] is None and got[5][3] == 1.0 and got[6][2] is None


def test_future_rows_change_nothing(spark):
    values = [0.1, -0.4, 0.3, 0.7, -0.5, 0.2, 0.1, 0.9]
    assert tone(spark, values + [5.0, -3.0])[: len(values)] == tone(spark, values)


def test_disagreement_needs_three_outlets(spark):
    two = spark.createDataFrame([row(1, 0.5, "a"), row(2, -0.5, "b")], SCHEMA)
    r = indicators.disagreement(two, ["a"], ["b"], ["x"]).first()
    assert r["cross_outlet_std"] is None and r["camp_gap"] == 1.0 and r["official_vs_media_gap"] is None and r["within_day_std"] == 0.5
    three = two.union(spark.createDataFrame([row(3, 0.0, "x")], SCHEMA))
    r = indicators.disagreement(three, ["a"], ["zz"], ["x"]).first()
    assert r["cross_outlet_std"] is not None and r["camp_gap"] is None and r["official_vs_media_gap"] == 0.0


def test_volume_has_all_and_no_zero_days(spark):
    rows = spark.createDataFrame([row(1, 0.1), row(2, 0.2, family="g"), row(3, 0.1, day=DAY + timedelta(days=3))], SCHEMA)
    got = {(r["signal_date"], r["family"]): r["headline_count"] for r in indicators.volume_counts(rows).collect()}
    assert got[DAY, "__all__"] == 2 and len(got) == 5


def test_session_change_is_by_session_index(spark):
    rows = spark.createDataFrame([row(i, float(i), day=DAY + timedelta(days=i), family="f" if i != 1 else "g") for i in range(7)], SCHEMA)
    means = rows.groupBy("signal_date", "family").agg(F.avg("score").alias("m"))
    got = {r["signal_date"]: r["change_5"] for r in indicators.change_over_sessions(means, rows, 5, "family", "m").where("family = 'f'").collect()}
    assert got[DAY + timedelta(days=5)] == 5.0 and got[DAY + timedelta(days=6)] is None
