"""Where scores come from: the event bridge, reviewed legacy scores, exclusion metadata, interrupted runs, and scoring in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import TIER_CREDIBILITY, lookup, source_credibility
from tidemark.sources.feeds import missing_keys

#: Fixed values.
RUN_COMPONENTS = ("scrape_status", "scoring_status", "aggregation_status", "market_data_status", "audit_status")
INTERRUPTED = "scheduler detected an interrupted run"
SCORE_BATCH, SCORE_ATTEMPTS, SCORE_BACKOFF = 50, 4, 15.0

#: What a stored event takes over from its headline.
SYNCED = {"direction": "score", "magnitude": "abs(score)", "sentiment_score": "score", "sentiment_label": "label", "model_version": "model_name", "signal_date": "signal_date"}


def bridge_events(headlines: DataFrame, events: DataFrame, tiers: Mapping[str, str]) -> DataFrame:
    """``events`` in step with the scores of their headlines, and one new event for each scored and dated headline that has none.

    A stored event whose headline is gone keeps NULL scores; one without a
    headline_id is not of a headline and stays as it is.  The tier of a source
    outside ``tiers`` is the lowest for new events and unchanged for stored ones.
    """
    values = headlines.select(F.col("id").alias("headline_id"), *[F.expr(e).alias(f"_{c}") for c, e in SYNCED.items()])
    of_headline = F.col("headline_id").isNotNull()
    stored_tier = lookup(F.col("source"), tiers)
    stored = events.join(values, "headline_id", "left").withColumns(
        {
            **{c: F.when(of_headline, F.col(f"_{c}")).otherwise(F.col(c)) for c in SYNCED},
            "source_tier": F.coalesce(stored_tier, "source_tier"),
            "credibility": F.coalesce(lookup(stored_tier, TIER_CREDIBILITY), "credibility"),
        }
    )
    tier, credibility = source_credibility(F.col("source"), tiers)
    dated = headlines.where("score IS NOT NULL AND published_date IS NOT NULL AND signal_date IS NOT NULL")
    fresh = dated.select(F.col("id").alias("headline_id"), "source", tier.alias("source_tier"), credibility.alias("credibility"), *[F.expr(e).alias(c) for c, e in SYNCED.items()])
    columns = ["headline_id", "source", "source_tier", "credibility", *SYNCED]
    return stored.select(*columns).unionByName(missing_keys(fresh, events, ["headline_id"]).select(*columns))


def reviewed_legacy(model: str, kinds: Sequence[str]) -> Column:
    """Whether a scored row without experiment may be given that of the reviewed scorer; NULL where its scorer is not known."""
    needed = ["score", "label", "scored_at", "p_positive", "p_neutral", "p_negative"]
    kind = F.col("score_components_kind")
    ok = (F.col("processing_status") == "scored") & (F.col("model_name") == model) & (kind.isNull() | kind.isin(*kinds)) & ~assigned_experiment()
    for c in needed:
        ok &= F.col(c).isNotNull()
    return ok


def assigned_experiment() -> Column:
    return F.trim(F.coalesce("experiment_id", F.lit(""))) != ""


def legacy_survey(rows: DataFrame, model: str, kinds: Sequence[str]) -> DataFrame:
    """state (eligible, already_assigned, blocked), model_name and n: what a backfill would change and what stays without provenance."""
    ok = reviewed_legacy(model, kinds)
    state = F.when(ok, "eligible").when(assigned_experiment(), "already_assigned").when(F.col("score").isNotNull() & ~ok, "blocked")
    named = rows.withColumn("state", state).where("state IS NOT NULL")
    return named.groupBy("state", F.coalesce("model_name", F.lit("<null>")).alias("model_name")).agg(F.count("*").alias("n"))


def legacy_backfill(rows: DataFrame, model: str, kinds: Sequence[str], experiment: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the reviewed experiment where they are eligible, and the audit of each row so changed."""
    ok = F.coalesce(reviewed_legacy(model, kinds), F.lit(False))
    audit = rows.where(ok).select("id", F.col("experiment_id").alias("before"), F.lit(experiment).alias("after"), F.lit("reviewed_legacy_backfill").alias("method"))
    return rows.withColumn("experiment_id", F.when(ok, F.lit(experiment)).otherwise(F.col("experiment_id"))), audit


def legacy_rollback(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Undoes ``audit`` on rows that still have what the backfill gave them."""
    marks = audit.select("id", F.col("before").alias("_before"), F.col("after").alias("_after"))
    undo = F.col("_after").isNotNull() & (F.col("experiment_id") == F.col("_after"))
    return rows.join(marks, "id", "left").withColumn("experiment_id", F.when(undo, F.col("_before")).otherwise(F.col("experiment_id"))).select(*rows.columns)


def exclusion_metadata(rows: DataFrame, rule: Column, version: str) -> DataFrame:
    """What rule, if any, excludes a row; when that was stored is not told here."""
    out = rows.withColumn("exclusion_rule", rule)
    excluded = F.col("exclusion_rule").isNotNull()
    return out.withColumns({"is_excluded": excluded, "exclusion_reason": F.when(excluded, "off_topic"), "exclusion_version": F.when(excluded, version)})


def close_interrupted_runs(runs: DataFrame, now: Column, components: Sequence[str] = RUN_COMPONENTS) -> DataFrame:
    """Runs still marked as running have failed: what ran in them failed, what was pending was skipped; finished runs stay as they are."""
    running = F.col("status") == "running"
    closed = {c: F.when(running & (F.col(c) == "running"), "failed").when(running & (F.col(c) == "pending"), "skipped").otherwise(F.col(c)) for c in components}
    return runs.withColumns(
        {
            **closed,
            "finished_at": F.when(running, now).otherwise(F.col("finished_at")),
            "error_msg": F.when(running, F.coalesce("error_msg", F.lit(INTERRUPTED))).otherwise(F.col("error_msg")),
            "status": F.when(running, "failed").otherwise(F.col("status")),
        }
    )


class TransientError(Exception):
    """What a scorer raises when asking again may help."""


def scored_in_batches(
    rows: DataFrame, scorer: Callable[[list[str]], Mapping[int, tuple[str, float]]], text: str = "text", batch: int = SCORE_BATCH, attempts: int = SCORE_ATTEMPTS, backoff: float = SCORE_BACKOFF
) -> DataFrame:
    """``rows`` with the label and strength that ``scorer`` gives by place in its list of texts.

    A place it leaves out stays NULL, as does a null text, which is never sent.
    A transient error is tried again after a longer wait each time, up to
    ``attempts`` times in all; then the task fails, and Spark repeats it.
    """

    def ask(texts: list[str]) -> Mapping[int, tuple[str, float]]:
        for k in range(1, attempts + 1):
            try:
                return scorer(texts)
            except TransientError:
                if k == attempts:
                    raise
                time.sleep(backoff * k)
        return {}

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple[str | None, float | None]] = [(None, None)] * len(part)
            known = [i for i, x in enumerate(part) if x is not None]
            for a in range(0, len(known), batch):
                places = known[a : a + batch]
                for i, value in ask([part.iloc[i] for i in places]).items():
                    if 0 <= i < len(places):
                        out[places[i]] = value
            yield pd.DataFrame(out, columns=["label", "strength"])

    scored = F.pandas_udf(score, "label string, strength double")
    return rows.withColumn("_scored", scored.asNondeterministic()(F.col(text))).withColumns({"label": F.col("_scored.label"), "strength": F.col("_scored.strength")}).drop("_scored")
