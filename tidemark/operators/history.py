"""Identity, deduplication, attempts, exclusions and other stateful storage rules, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import fold

#: Fixed value: scoring attempts before an item has failed.
MAX_ATTEMPTS = 3


def identity(rows: DataFrame) -> list[Column]:
    return [F.col("source"), F.substring(fold(F.col("title")), 1, 80), F.col("published_date")]


def new_canonical(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows to insert: the first of each identity and of each URL that is not there yet."""
    names = ["_source", "_title", "_date"]
    add = lambda df: df.withColumns(dict(zip(names, identity(df))))
    first = add(incoming).withColumn("_r", F.row_number().over(W.partitionBy(*names).orderBy("id"))).where("_r = 1")
    first = first.withColumn("_r", F.row_number().over(W.partitionBy("url").orderBy("id"))).where("_r = 1 OR url IS NULL").drop("_r")
    old = add(existing)
    fresh = first.join(old.select(*names), names, "left_anti").join(old.where("url IS NOT NULL").select("url"), "url", "left_anti")
    return fresh.select(*incoming.columns)


def link_observations(observations: DataFrame, canonical: DataFrame) -> DataFrame:
    """Each observation's canonical id: by URL, else by source, folded title and date; the lowest id wins."""
    by_url = canonical.where("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("_u"))
    names = ["_source", "_title", "_date"]
    by_title = canonical.withColumns(dict(zip(names, identity(canonical)))).groupBy(*names).agg(F.min("id").alias("_t"))
    o = observations.withColumns(dict(zip(names, identity(observations))))
    linked = o.join(by_url, "url", "left").join(by_title, names, "left")
    how = F.when(F.col("_u").isNotNull(), "url").when(F.col("_t").isNotNull(), "title")
    return linked.withColumns({"headline_id": F.coalesce("_u", "_t"), "link": how}).select(*observations.columns, "headline_id", "link")


def fold_attempts(attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each item after its attempts (id, seq, ok): scored at the first success, failed after ``most`` failures before it, else retry_pending."""
    success = F.min(F.when(F.col("ok"), F.col("seq")))
    g = attempts.groupBy("id").agg(success.alias("_s"), F.collect_list(F.when(~F.col("ok"), F.col("seq"))).alias("_f"))
    failures = F.size(F.filter("_f", lambda x: F.col("_s").isNull() | (x < F.col("_s"))))
    status = F.when(failures >= most, "failed").when(F.col("_s").isNotNull(), "scored").otherwise("retry_pending")
    return g.select("id", F.least(failures, F.lit(most)).cast("long").alias("failures"), status.alias("status"))


def validated_scores(responses: DataFrame) -> DataFrame:
    """Usable rows of scorer responses (batch, idx, label, strength): an index answered twice counts for nothing, nor do bad labels or strengths."""
    n = F.count("*").over(W.partitionBy("batch", "idx"))
    good = F.col("label").isin("positive", "neutral", "negative") & F.col("strength").between(0, 1) & (F.col("idx") >= 0)
    return responses.withColumn("_n", n).where((F.col("_n") == 1) & good).drop("_n")


def reconcile_exclusions(graded: DataFrame, history: DataFrame, cutoff: float = 0.25, rule: str = "relevance-v1") -> tuple[DataFrame, DataFrame]:
    """(to exclude, to restore) after a new grade.

    A row below the cutoff without an active exclusion is excluded, unless a user
    restored it under this rule after its grade; an active exclusion by the rule
    is restored when the grade is at or over the cutoff.
    """
    active = history.where("restored_at IS NULL").select(F.col("headline_id").alias("id"), F.lit(1).alias("_a"))
    override = history.where((F.col("restored_by") == "user") & (F.col("rule_version") == rule)).groupBy(F.col("headline_id").alias("id")).agg(F.max("restored_at").alias("_o"))
    g = graded.join(active, "id", "left").join(override, "id", "left")
    low = F.col("relevance") < cutoff
    exclude = g.where(low & F.col("_a").isNull() & (F.col("_o").isNull() | (F.col("_o") < F.col("graded_at"))))
    restore = g.where(~low & F.col("_a").isNotNull())
    return exclude.select("id", "relevance"), restore.select("id", "relevance")


def experiment_identity(rows: DataFrame) -> Column:
    """The stated experiment, else the model's name; blanks count as missing."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(F.col("experiment_id")), blank(F.col("model_name")), F.lit("unknown"))


def guard_single_experiment(rows: DataFrame) -> DataFrame:
    """``rows``, or an error when they mix experiments."""
    names = [r[0] for r in rows.select(experiment_identity(rows)).distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"mixed experiments: {names[0]}, {names[1]}, ...")
    return rows


def run_status(components: DataFrame) -> DataFrame:
    """failed over degraded over success, for each run."""
    rank = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return components.groupBy("run_id").agg(F.element_at(F.array(F.lit("success"), F.lit("degraded"), F.lit("failed")), rank + 1).alias("status"))


def relabel(rows: DataFrame, positive: float = 0.05, negative: float = -0.05) -> DataFrame:
    """Rows whose label differs from that of their components, with the new label."""
    score = F.col("p_positive") - F.col("p_negative")
    label = F.when(score > positive, "positive").when(score < negative, "negative").otherwise("neutral")
    return rows.where(score.isNotNull()).withColumn("new_label", label).where(~F.col("label").eqNullSafe(F.col("new_label")))
