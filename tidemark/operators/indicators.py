"""Strictly prior-window indicators, volume and disagreement."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Observed dates in a window, and those needed for a value.
SESSIONS, MIN_HISTORY = 20, 5
STRONG, MIN_SOURCES = 0.5, 3


def prior_window(values: DataFrame, keys: list[str], date: str, value: str, sessions: int = SESSIONS, least: int = MIN_HISTORY) -> DataFrame:
    """``values`` with prior_n, prior_mean, prior_std, z_score and percentile over the previous ``sessions`` observed dates of the key.

    The current date is never in its window.  Below ``least`` dates all are NULL;
    with a constant history z is NULL but the percentile is not.
    """
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(-sessions, -1)
    x = F.col(value)
    n = F.count(x).over(w)
    enough = lambda c: F.when(n >= least, c)
    history = F.collect_list(x).over(w)
    out = values.withColumns({"_n": n, "_m": F.avg(x).over(w), "_s": F.stddev_pop(x).over(w), "_h": history})
    share = F.size(F.filter("_h", lambda v: v <= x)) / F.col("_n")
    enough = lambda c: F.when(F.col("_n") >= least, c)
    # a deviation this small against the mean is the rounding of a constant history
    spread = F.col("_s") > F.greatest(F.abs("_m"), F.lit(1.0)) * 1e-12
    return out.withColumns(
        {
            "prior_n": F.col("_n"),
            "prior_mean": enough(F.col("_m")),
            "prior_std": enough(F.col("_s")),
            "z_score": enough(F.when(spread, (x - F.col("_m")) / F.col("_s"))),
            "percentile": enough(F.when(x.isNotNull(), share)),
        }
    ).drop("_n", "_m", "_s", "_h")


def scoped_means(rows: DataFrame, date: str = "signal_date") -> DataFrame:
    """Daily mean scores by outlet, family, and outlet within family: one pass by grouping sets."""
    scored = rows.where(F.col("score").isNotNull())
    sets = scored.groupingSets([["signal_date", "source"], ["signal_date", "family"], ["signal_date", "source", "family"]], "signal_date", "source", "family") if date == "signal_date" else None
    g = sets.agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"), F.grouping_id("signal_date", "source", "family").alias("g"))
    scope = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "family").otherwise("source_family")
    key = F.when(F.col("g") == 1, F.col("source")).when(F.col("g") == 2, F.col("family")).otherwise(F.concat_ws("|", "source", "family"))
    return g.select(scope.alias("scope"), key.alias("key"), "signal_date", "mean_score", "n")


def abnormal_tone(rows: DataFrame, **options) -> DataFrame:
    return prior_window(scoped_means(rows), ["scope", "key"], "signal_date", "mean_score", **options)


def volume_counts(rows: DataFrame) -> DataFrame:
    """Headlines, distinct observations and outlets by family and over all, where there are any; no day is filled with zero."""
    seen = F.coalesce(F.concat(F.lit("e"), F.col("event_ref").cast("string")), F.concat(F.lit("h"), F.col("id").cast("string")))
    g = rows.groupingSets([["signal_date", "family"], ["signal_date"]], "signal_date", "family").agg(
        F.count("*").alias("headline_count"), F.count_distinct(seen).alias("observation_count"), F.count_distinct("source").alias("source_count"), F.grouping_id("signal_date", "family").alias("g")
    )
    return g.select("signal_date", F.when(F.col("g") == 1, "__all__").otherwise(F.col("family")).alias("family"), "headline_count", "observation_count", "source_count")


def volume_shock(counts: DataFrame, value: str = "headline_count", lags: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    w = W.partitionBy("family").orderBy("signal_date")
    out = prior_window(counts.withColumn("_v", F.col(value).cast("double")), ["family"], "signal_date", "_v").drop("_v")
    return out.withColumns({f"change_{n}": (F.col(value) - F.lag(value, n).over(w)).cast("double") for n in lags if n <= SESSIONS})


def entropy3(*shares: Column) -> Column:
    """Entropy to base 3; a share of zero adds nothing."""
    total = F.lit(0.0)
    for p in shares:
        total = total + F.when(p > 0, -p * F.log(p) / math.log(3)).otherwise(0.0)
    return total


def disagreement(rows: DataFrame, pro: list[str], opposition: list[str], official: list[str], keys: tuple[str, ...] = ("signal_date", "family")) -> DataFrame:
    """Spread of scores within a group, and between its outlets where there are MIN_SOURCES.

    Two levels: partial sums by outlet, then over outlets, so the heavy rows are
    shuffled once.
    """
    s, source = F.col("score"), F.col("source")
    r = rows.where(s.isNotNull())
    camp = lambda names: source.isin(*names)
    by_source = r.groupBy(*keys, "source").agg(
        F.count("*").alias("n"), F.sum("score").alias("t"), F.sum(s * s).alias("q"), F.count_if(s >= STRONG).alias("sp"), F.count_if(s <= -STRONG).alias("sn"),
        F.count_if(F.col("label") == "positive").alias("pos"), F.count_if(F.col("label") == "neutral").alias("neu"), F.count_if(F.col("label") == "negative").alias("neg"),
    )
    m = F.col("t") / F.col("n")
    named = F.when(source != "", m)
    agg = by_source.groupBy(*keys).agg(
        F.sum("n").alias("headline_count"), F.count(named).alias("source_count"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("sp").alias("sp"), F.sum("sn").alias("sn"),
        F.sum("pos").alias("pos"), F.sum("neu").alias("neu"), F.sum("neg").alias("neg"), F.stddev_pop(named).alias("om"), (F.max(named) - F.min(named)).alias("rng"),
        *[F.sum(F.when(c, F.col(x))).alias(f"{x}_{k}") for k, c in (("p", camp(pro)), ("o", camp(opposition)), ("f", camp(official)), ("g", ~camp(official))) for x in ("t", "n")],
        F.count_if(camp(pro) | camp(opposition)).alias("camps"),
    )
    n, labelled = F.col("headline_count"), F.col("pos") + F.col("neu") + F.col("neg")
    wide = F.col("source_count") >= MIN_SOURCES
    gap = F.col("t_p") / F.col("n_p") - F.col("t_o") / F.col("n_o")
    var = F.greatest(F.col("q") / n - F.pow(F.col("t") / n, 2), F.lit(0.0))
    return agg.select(
        *keys, "headline_count", "source_count",
        F.when(n > 1, F.sqrt(var)).alias("within_day_std"), F.when(wide, F.col("om")).alias("cross_outlet_std"), F.when(wide, F.col("rng")).alias("max_minus_min"),
        (F.col("sp") / n).alias("strong_positive_share"), (F.col("sn") / n).alias("strong_negative_share"),
        F.when(labelled > 0, entropy3(F.col("pos") / labelled, F.col("neu") / labelled, F.col("neg") / labelled)).alias("sentiment_entropy"),
        gap.alias("camp_gap"), F.when(gap.isNotNull(), F.col("camps")).cast("double").alias("camp_gap_sources"),
        (F.col("t_f") / F.col("n_f") - F.col("t_g") / F.col("n_g")).alias("official_vs_media_gap"), wide.cast("int").alias("min_sources_met"),
    )


def change_over_sessions(series: DataFrame, sessions: DataFrame, back: int, key: str, value: str) -> DataFrame:
    """The change of ``value`` against ``back`` sessions before, by the index of sessions and not by the key's own rows."""
    index = F.broadcast(sessions.select("signal_date").distinct().withColumn("_i", F.dense_rank().over(W.orderBy("signal_date"))))
    now = series.join(index, "signal_date")
    then = now.select(F.col(key).alias("_k"), (F.col("_i") + back).alias("_j"), F.col(value).alias("_then"))
    return now.join(then, (F.col(key) == F.col("_k")) & (F.col("_i") == F.col("_j")), "left").withColumn(f"change_{back}", F.col(value) - F.col("_then")).drop("_k", "_j", "_then", "_i")


def regime_report(family: DataFrame, tone: DataFrame, volume: DataFrame, spread: DataFrame, composite: str = "__domestic__") -> DataFrame:
    """Sufficient families of each date, ranked by absolute tone, with flags for unusual tone, volume and disagreement."""
    f = family.where((F.col("sample_sufficiency") == "sufficient") & ~F.col("family").isin(composite, "market_recap"))
    t = tone.where("scope = 'family'").select("signal_date", F.col("key").alias("family"), "percentile")
    out = f.join(t, ["signal_date", "family"], "left")
    out = out.join(volume.select("signal_date", "family", F.col("z_score").alias("volume_z")), ["signal_date", "family"], "left")
    out = out.join(spread.select("signal_date", "family", "within_day_std"), ["signal_date", "family"], "left")
    rank = F.row_number().over(W.partitionBy("signal_date").orderBy(F.desc(F.abs("simple_mean")), "family"))
    return out.select(
        "signal_date", "family", "simple_mean", "headline_count", rank.alias("rank"),
        F.coalesce((F.col("percentile") >= 0.9) | (F.col("percentile") <= 0.1), F.lit(False)).alias("unusual"),
        F.coalesce(F.col("volume_z") >= 1.5, F.lit(False)).alias("elevated_volume"),
        F.coalesce(F.col("within_day_std") >= 0.3, F.lit(False)).alias("elevated_disagreement"),
    )


def extreme_items(rows: DataFrame, keys: Sequence[str], score: str = "score", item: str = "id") -> DataFrame:
    """keys, top_item and bottom_item: the items that drive a group's tone up and down most; the lowest id first among equals."""
    scored = rows.where(F.col(score).isNotNull())
    first = lambda value: F.min_by(item, F.struct(value, item))
    return scored.groupBy(*keys).agg(first(F.negative(score)).alias("top_item"), first(F.col(score)).alias("bottom_item"))


def regime_families(family: DataFrame, tone: DataFrame, volume: DataFrame, spread: DataFrame, rows: DataFrame) -> DataFrame:
    """Everything a regime report says of each family on each session: level, change, surprise, attention, disagreement, drivers and quality.

    Changes are against 5 and 20 sessions before, by the index of sessions that
    have any family; a family without a row then has no change.  What is not known
    stays null, and its flag is false.
    """
    on = ["signal_date", "family"]
    out = family.withColumn("market_recap_share", F.try_divide("market_recap_count", F.nullif("headline_count", F.lit(0))))
    out = out.withColumn("timing_degraded", F.col("unknown_timing_count") > 0)
    for back in (5, 20):
        change = change_over_sessions(family.select(*on, "simple_mean"), family, back, "family", "simple_mean")
        out = out.join(change.select(*on, F.col(f"change_{back}").alias(f"vs_{back}_sessions")), on, "left")
    surprise = tone.where("scope = 'family'").select("signal_date", F.col("key").alias("family"), F.col("z_score").alias("tone_z"), F.col("percentile").alias("tone_percentile"))
    attention = volume.select(*on, "observation_count", F.col("z_score").alias("volume_z"), F.col("percentile").alias("volume_percentile"))
    apart = spread.select(*on, "within_day_std", "cross_outlet_std", "max_minus_min", "camp_gap", "min_sources_met")
    for part in (surprise, attention, apart, extreme_items(rows, on)):
        out = out.join(part, on, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns(
        {
            "is_unusual": flag((F.col("tone_percentile") >= 0.9) | (F.col("tone_percentile") <= 0.1)),
            "is_elevated": flag(F.col("volume_z") >= 1.5),
            "is_disagreed": flag(F.col("within_day_std") >= 0.3),
        }
    )


def session_tone(tone: DataFrame, domestic: list[str]) -> DataFrame:
    """Mean tone surprise over the families of a session that have one, and over the domestic ones; families without are absent, not zero."""
    known = tone.where((F.col("scope") == "family") & F.col("z_score").isNotNull())
    at_home = F.when(F.col("key").isin(domestic), F.col("z_score"))
    return known.groupBy("signal_date").agg(F.avg("z_score").alias("all_families"), F.avg(at_home).alias("domestic"), F.count("*").alias("n_families"))
