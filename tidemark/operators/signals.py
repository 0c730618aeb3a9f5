"""Weighted signal variants and family signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import finite, legacy_time_weight
from tidemark.operators.order_stats import grouped_quantiles

COMPOSITE = "__domestic__"


def active_exclusions(exclusions: DataFrame) -> DataFrame:
    return exclusions.where("NOT restored").select(F.col("headline_id").alias("id"))


def eligible_headlines(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Scored, published rows that are not actively excluded."""
    complete = F.col("score").isNotNull() & F.col("label").isNotNull() & F.col("published_date").isNotNull() & F.col("source").isNotNull()
    return rows.where(complete).join(active_exclusions(exclusions), "id", "left_anti")


#: What a scored headline has to have.
COMPLETE = ("score", "label", "model_name", "scored_at", "p_positive", "p_neutral", "p_negative", "published_date")


def fully_eligible(rows: DataFrame, exclusions: DataFrame, status: str = "processing_status") -> DataFrame:
    """Rows whose processing is done, with all COMPLETE fields, that are not actively excluded."""
    whole = F.col(status) == "scored"
    for c in COMPLETE:
        whole = whole & F.col(c).isNotNull()
    return rows.where(whole).join(active_exclusions(exclusions), "id", "left_anti")


def unscored_queue(rows: DataFrame, exclusions: DataFrame, status: str = "processing_status") -> DataFrame:
    """What waits for a score: pending or to be tried again, and not actively excluded."""
    return rows.where(F.col(status).isin("pending", "retry_pending")).join(active_exclusions(exclusions), "id", "left_anti")


def epochs(rows: DataFrame, session: str, boundary: str, before: str = "development", after: str = "holdout") -> DataFrame:
    """``rows`` with epoch: the side of the boundary that their session is on; without a session, neither."""
    day = F.col(session).cast("date")
    return rows.withColumn("epoch", F.when(day >= F.lit(boundary).cast("date"), after).when(day.isNotNull(), before))


def _mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)))


def signal_variants(rows: DataFrame, *keys: str, floor: float = 0.10, source_weight: Column | None = None, category_weight: Column | None = None) -> DataFrame:
    """The four variants and their audit fields for each group.

    simple mean; relevance-weighted; intensity times relevance; and full, which
    adds source, time and category weights.  A zero sum of weights gives NULL,
    never the plain mean.  Missing relevance weighs 1; intensity is the absolute
    score, ``floor`` at least.
    """
    s = finite(F.col("score"))
    relevance = F.coalesce(F.col("relevance"), F.lit(1.0))
    intensity = F.greatest(F.abs(s), F.lit(floor))
    full = relevance * intensity * legacy_time_weight(F.col("hour")) * (source_weight if source_weight is not None else F.lit(1.0)) * (category_weight if category_weight is not None else F.lit(1.0))
    t = rows.withColumns({"_s": s, "_r": F.when(s.isNotNull(), relevance), "_ir": F.when(s.isNotNull(), relevance * intensity), "_f": F.when(s.isNotNull(), full)})
    scored = F.col("_s").isNotNull()
    label = lambda name: F.count_if(scored & (F.col("label") == name))
    out = t.groupBy(*keys).agg(
        F.avg("_s").alias("simple_mean"),
        _mean(F.col("_s"), F.col("_r")).alias("relevance_weighted"),
        _mean(F.col("_s"), F.col("_ir")).alias("intensity_relevance_weighted"),
        _mean(F.col("_s"), F.col("_f")).alias("full_weighted"),
        F.count("_s").alias("headline_count"),
        F.count("*").alias("input_count"),
        label("positive").alias("positive_count"),
        label("negative").alias("negative_count"),
        label("neutral").alias("neutral_count"),
        F.stddev_pop("_s").alias("dispersion"),
        F.count_distinct(F.when(scored & (F.col("source") != ""), F.col("source"))).alias("source_count"),
        F.count_distinct(F.when(scored, F.col("event_ref"))).alias("event_count"),
        F.coalesce(F.sum("_r"), F.lit(0.0)).alias("relevance_weight_sum"),
        F.coalesce(F.sum("_ir"), F.lit(0.0)).alias("intensity_relevance_weight_sum"),
        F.coalesce(F.sum("_f"), F.lit(0.0)).alias("full_weight_sum"),
    )
    n = F.col("headline_count")
    out = out.withColumns({"excluded_incomplete_score_count": F.col("input_count") - n, "unclassified_count": n - F.col("positive_count") - F.col("negative_count") - F.col("neutral_count")})
    return out.withColumns({f"{x}_share": F.try_divide(F.col(f"{x}_count"), F.nullif(n, F.lit(0))) for x in ("positive", "negative", "neutral")})


def legacy_row(variants: DataFrame) -> DataFrame:
    """avg_score is the full variant; bull_bear is the positive share of signed labels."""
    signed = F.col("positive_count") + F.col("negative_count")
    return variants.withColumns({"avg_score": F.col("full_weighted"), "bull_bear": F.try_divide(F.col("positive_count"), F.nullif(signed, F.lit(0)))})


def sufficiency(headlines: Column, sources: Column, thin: int = 3) -> Column:
    return F.when(headlines == 0, "insufficient").when(headlines < thin, "thin").when(sources < 2, "single_source").otherwise("sufficient")


def family_signals(rows: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Family signal of each group; breadth counts all outlets that carried a headline, not only its own."""
    s = finite(F.col("score"))
    base = rows.groupBy(*keys).agg(
        F.avg(s).alias("simple_mean"),
        _mean(s, F.coalesce(F.col("relevance"), F.lit(1.0))).alias("relevance_weighted"),
        F.min(s).alias("min_sentiment"),
        F.max(s).alias("max_sentiment"),
        F.when(F.count(s) > 1, F.stddev_pop(s)).alias("sentiment_std"),
        F.count(s).alias("headline_count"),
        F.avg("relevance").alias("avg_relevance"),
        F.sum("is_recap").alias("market_recap_count"),
        F.count_if(F.col("timing_bucket").isNull() | F.col("timing_bucket").isin("", "unknown")).alias("unknown_timing_count"),
        F.count_if(s.isNull()).alias("unresolved_count"),
        F.sum("is_ambiguous").alias("ambiguous_count"),
    )
    medians = grouped_quantiles(rows, keys, s, {"median_sentiment": 0.5})
    carried = rows.select("id", *keys).join(observed, "id").where("source <> ''").groupBy(*keys).agg(F.count_distinct("source").alias("source_count"))
    same = lambda side: reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"{side}.{k}")) for k in keys])
    out = base.alias("b").join(carried.alias("c"), same("c"), "left").join(medians.alias("m"), same("m"), "left")
    out = out.select("b.*", "m.median_sentiment", F.coalesce("c.source_count", F.lit(0)).alias("source_count"))
    return out.withColumn("sample_sufficiency", sufficiency(F.col("headline_count"), F.col("source_count")))


def with_composite(rows: DataFrame, families: list[str], column: str = "family") -> DataFrame:
    """``rows``, and those of ``families`` again under the composite's name."""
    return rows.unionByName(rows.where(F.col(column).isin(*families)).withColumn(column, F.lit(COMPOSITE)))
