"""Event bridge, legacy backfill and rollback, interrupted runs, and batches of an injected scorer."""

import pytest

from tidemark.operators import events, provenance, reports

HEADLINE = "id long, source string, published_date string, signal_date string, score double, label string, model_name string"
EVENT = "headline_id long, source string, source_tier string, credibility double, direction double, magnitude double, sentiment_score double, sentiment_label string, model_version string, signal_date string"


def test_bridge_syncs_inserts_and_leaves_the_rest(spark):
    h = spark.createDataFrame(
        [(1, "a", "d", "s1", -0.5, "negative", "m"), (2, "b", "d", "s1", None, None, "m"), (3, "x", "d", "s2", 0.25, "positive", "m"), (4, "a", None, "s2", 0.3, "positive", "m")], HEADLINE
    )
    old = (0.9, 0.9, 0.9, "positive", "old", "s0")
    e = spark.createDataFrame([(1, "a", "C", 0.5, *old), (9, "x", "Z", 0.1, *old), (None, "b", "Z", 0.1, *old)], EVENT)
    out = {r.headline_id: r for r in provenance.bridge_events(h, e, {"a": "A", "b": "B"}).collect()}
    assert set(out) == {1, 3, 9, None}  # 2 has no score, 4 no date
    assert (out[1].source_tier, out[1].credibility, out[1].direction, out[1].magnitude, out[1].signal_date) == ("A", 1.0, -0.5, 0.5, "s1")
    assert (out[3].source_tier, out[3].credibility, out[3].direction) == ("C", 0.5, 0.25)
    assert (out[9].source_tier, out[9].credibility, out[9].direction) == ("Z", 0.1, None)  # its headline is gone
    assert (out[None].source_tier, out[None].credibility, out[None].direction) == ("B", 0.75, 0.9)
    assert provenance.bridge_events(h, e.limit(0), {}).count() == 2
    assert provenance.bridge_events(h.limit(0), e, {}).count() == 3


def test_backfill_changes_eligible_rows_alone_and_rolls_back(spark):
    full = dict(score=0.1, label="positive", scored_at="t", p_positive=0.1, p_neutral=0.9, p_negative=0.0, processing_status="scored", model_name="m", score_components_kind=None, experiment_id=None)
    changes = [{}, {"experiment_id": "e0"}, {"model_name": "other"}, {"model_name": None}, {"score_components_kind": "bad"}, {"p_neutral": None}, {"score_components_kind": "good", "experiment_id": " "}]
    schema = "id long, score double, label string, scored_at string, p_positive double, p_neutral double, p_negative double, processing_status string, model_name string, score_components_kind string, experiment_id string"
    rows = spark.createDataFrame([{"id": i, **full, **c} for i, c in enumerate(changes)], schema)
    survey = {(r.state, r.model_name): r.n for r in provenance.legacy_survey(rows, "m", ["good"]).collect()}
    assert survey == {("eligible", "m"): 2, ("already_assigned", "m"): 1, ("blocked", "other"): 1, ("blocked", "m"): 2}  # an unknown scorer is neither
    done, audit = provenance.legacy_backfill(rows, "m", ["good"], "new")
    assert {r.id: r.experiment_id for r in done.collect()} == {0: "new", 1: "e0", 2: None, 3: None, 4: None, 5: None, 6: "new"}
    assert sorted(r.id for r in audit.collect()) == [0, 6]
    assert sorted(provenance.legacy_rollback(done, audit).collect()) == sorted(rows.collect())


def test_scoring_in_batches_retries_and_leaves_out(spark, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        with open(log) as f:
            if len(f.readlines()) == 1:
                raise provenance.TransientError
        return {i: ("neutral", float(len(x))) for i, x in enumerate(texts) if x != "skip"} | {99: ("positive", 1.0)}

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "skip", "abc", "", "de"])], "id int, text string").coalesce(1)
    out = {r.id: (r.label, r.strength) for r in provenance.scored_in_batches(rows, scorer, batch=2, backoff=0.0).collect()}
    assert out == {0: ("neutral", 1.0), 1: (None, None), 2: (None, None), 3: ("neutral", 3.0), 4: ("neutral", 0.0), 5: ("neutral", 2.0)}
    assert open(log).read().split() == ["2", "2", "2", "1"]

    def down(texts):
        raise provenance.TransientError

    with pytest.raises(Exception, match="TransientError"):
        provenance.scored_in_batches(rows, down, attempts=2, backoff=0.0).collect()
    assert provenance.scored_in_batches(rows.limit(0), scorer).columns == ["id", "text", "label", "strength"]


def test_a_group_may_be_in_several_strata_and_residuals_stay_null(spark):
    groups = spark.createDataFrame([("a", 2, 2, 1), ("b", 2, 1, 2), ("c", 1, 1, None)], "group_key string, headline_count int, source_count int, signal_date_span int")
    members = spark.createDataFrame([("a", 0.1, "seed"), ("a", 0.9, "entity+family+time+title"), ("b", 0.35, "family+time+title_only"), ("b", 0.95, None)], "group_key string, similarity double, match_rule string")
    found = {(r.stratum, r.group_key) for r in reports.review_strata(groups, members).collect()}
    assert found == {("multi_source", "a"), ("high_similarity", "a"), ("entity_based", "a"), ("multi_headline_single_source", "b"), ("threshold_near", "b"), ("title_only", "b"), ("cross_session", "b")}
    rows = spark.createDataFrame([("d1", "w"), ("d2", "w")], "exit_date string, window_name string")
    long = spark.createDataFrame([("d1", "w", "fx", 0.5)], "exit_date string, window_name string, control_set string, residual double")
    got = {r.exit_date: (r.residual_fx, r.residual_none) for r in events.with_residuals(rows, long, ["fx", "none"]).collect()}
    assert got == {"d1": (0.5, None), "d2": (None, None)}


def test_hash_tree_of_three_levels_may_end_in_several_nodes(spark):
    from tidemark.operators import reports

    tree = reports.hash_tree(spark.range(16).withColumnRenamed("id", "k"), "k", ["k"], leaf_keys=1, fan=2, levels=3)
    assert {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()} == {0: 16, 1: 8, 2: 4}
