"""Coverage, quality and agreement reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.pairs import both_ways, overlap_links
from tidemark.sources.shared import written

#: Fixed value: similarity from which two groups that did not merge are worth a look, the threshold with a common entity less a band of 0.08.
NEAR_MISS = 0.22
#: Keys of a leaf of a hash tree, and children of a node.
LEAF_KEYS, FAN = 1024, 64


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column, with the columns named beforehand."""
    return rows.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def coverage(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and shares by each column and by all together, in one pass of grouping sets."""
    sets = [[c] for c in by] + [list(by)]
    g = rows.groupingSets(sets, *by).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.grouping_id(*by).alias("g"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("g")))


def share_distance(rows: DataFrame, camp: Column, category: str) -> DataFrame:
    """Share of each category in camps "a" and "b", and the total variation distance of the two."""
    c = rows.withColumn("_camp", camp).where("_camp IS NOT NULL").groupBy("_camp", category).agg(F.count("*").alias("n"))
    s = c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("_camp"))).groupBy(category).pivot("_camp", ["a", "b"]).agg(F.first("share")).na.fill(0.0, ["a", "b"])
    return s.withColumn("total_variation", F.sum(F.abs(F.col("a") - F.col("b"))).over(W.partitionBy()) * 0.5)


def shared_event_gaps(rows: DataFrame, camp: Column, event: str, value: str) -> DataFrame:
    """Mean of both camps for each event that both cover, and the gap."""
    p = rows.withColumn("_camp", camp).where("_camp IS NOT NULL").groupBy(event).pivot("_camp", ["a", "b"]).agg(F.avg(value))
    return p.where("a IS NOT NULL AND b IS NOT NULL").withColumn("gap", F.col("a") - F.col("b"))


def framing(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.stddev_samp("gap").alias("std_gap"), F.avg((F.col("gap") > 0).cast("double")).alias("positive_share"))


def source_quality(rows: DataFrame) -> DataFrame:
    """Rows, share without a time, mean strength, share of low relevance, and modal category of each source."""
    base = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.avg(F.col("published_ts").isNull().cast("double")).alias("untimed_share"), F.avg(F.abs("score")).alias("mean_strength"), F.avg(F.when(F.col("relevance").isNotNull(), (F.col("relevance") < 0.25).cast("double"))).alias("thin_share")
    )
    modal = rows.groupBy("source", "category").agg(F.count("*").alias("k")).groupBy("source").agg(F.min_by("category", F.struct(-F.col("k"), "category")).alias("modal_category"))
    return base.join(modal, "source")


def feed_verdict(quality: DataFrame) -> DataFrame:
    good = (F.col("untimed_share") < 0.2) & (F.col("thin_share") < 0.3)
    return quality.withColumn("verdict", F.when(F.col("n") < 20, "SKIP").when(good, "ADD").otherwise("MARGINAL"))


def daily_spine(rows: DataFrame, date: str) -> DataFrame:
    """Rows of each day from the first to the last, zero for days without any."""
    counts = rows.groupBy(date).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min(date), F.max(date))).alias(date))
    return span.join(counts, date, "left").na.fill(0, ["n"])


def extremes(rows: DataFrame, by: str, value: str, least: int = 20) -> DataFrame:
    """The groups with the highest and lowest means among those of ``least`` rows or more."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)
    return g.agg(F.max_by(by, F.struct("mean", by)).alias("highest"), F.max("mean").alias("highest_mean"), F.min_by(by, F.struct("mean", by)).alias("lowest"), F.min("mean").alias("lowest_mean"))


def confusion(rows: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts by predicted label, recall and the top mistake of each actual label."""
    m = rows.groupBy(actual).pivot(predicted, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))
    total = sum((F.col(x) for x in labels), F.lit(0))
    right = F.coalesce(*[F.when(F.col(actual) == x, F.col(x)) for x in labels])
    wrong = F.array(*[F.struct(F.when((F.col(actual) != x) & (F.col(x) > 0), F.col(x)).alias("n"), F.lit(x).alias("label")) for x in labels])
    worst = F.array_sort(F.filter(wrong, lambda s: s["n"].isNotNull()), lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["label"] < b["label"], -1).otherwise(1))
    return m.withColumns({"recall": F.try_divide(right, F.nullif(total, F.lit(0))), "top_mistake": F.get(worst, F.lit(0))["label"]})


def threshold_sweep(rows: DataFrame, score: str, truth: Column, steps: int = 50, size: float = 0.01) -> DataFrame:
    """Accuracy of each threshold 0, 0.01, ...; the first best is marked.

    Scores are counted by the step that they reach, so the rows are shuffled once
    and not once for each threshold.
    """
    # a score passes threshold i if it is at least i * size
    step = F.least(F.lit(steps), F.floor(F.col(score) / size + 1e-9)).cast("int")
    c = rows.where(F.col(score).isNotNull() & truth.isNotNull()).groupBy(step.alias("step")).agg(F.count_if(truth).alias("t"), F.count_if(~truth).alias("f"))
    grid = rows.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("i"))
    at = grid.join(F.broadcast(c), F.lit(True)).groupBy("i").agg(
        (F.sum(F.when(F.col("step") >= F.col("i"), F.col("t")).otherwise(F.col("f")))).alias("right"), F.sum(F.col("t") + F.col("f")).alias("n")
    )
    out = at.select((F.col("i") * size).alias("threshold"), (F.col("right") / F.col("n")).alias("accuracy"))
    best = F.first("threshold").over(W.orderBy(F.desc("accuracy"), "threshold"))
    return out.withColumn("is_best", F.col("threshold") == best)


def row_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An order-free digest of the rows: count and sum of row hashes; nothing is gathered."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256), 1, 12), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def hash_tree(rows: DataFrame, key: str, columns: Sequence[str], leaf_keys: int = LEAF_KEYS, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """level, node, n, digest: an ordered digest of ``rows`` as a tree over ranges of a whole-number key; the highest level has one node.

    With ``levels``, no more than that are built, and the highest may have several nodes.  A leaf (level 0) is the hash of its rows' hashes in the order of (key, hash), a
    node that of its children's in their order.  Equal roots mean equal rows in
    equal order; where roots differ, ``tree_differences`` finds the ranges.  Leaves
    are cut by key, so a change elsewhere does not move them; a leaf gathers the
    hashes of ``leaf_keys`` keys (a key should not be repeated without bound), and
    all else is smaller by ``fan`` from level to level.  Rows with a null key
    are a leaf of their own, -1.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    leaf = F.coalesce(F.floor(F.col(key) / leaf_keys).cast("long"), F.lit(-1))
    ordered = lambda items, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), items.alias("h")))), lambda x: x["h"]), "")
    level = rows.groupBy(leaf.alias("node")).agg(F.count("*").alias("n"), F.sha2(ordered(row, F.coalesce(F.col(key).cast("long"), F.lit(0))), 256).alias("digest"))
    out, number = [], 0
    while True:
        level = written(level.select(F.lit(number).alias("level"), "node", "n", "digest"))
        out.append(level)
        if level.count() <= 1 or number + 1 == levels:
            return reduce(DataFrame.unionByName, out)
        up = F.when(F.col("node") < 0, F.col("node")).otherwise(F.floor(F.col("node") / fan)).cast("long")
        # when only the leaf of null keys and one other node are left, they meet
        if level.count() == 2 and level.where("node <= 0").count() == 2:
            up = F.lit(0).cast("long")
        number += 1
        level = level.groupBy(up.alias("node")).agg(F.sum("n").alias("n"), F.sha2(ordered(F.col("digest"), F.col("node")), 256).alias("digest"))


def tree_differences(before: DataFrame, after: DataFrame, leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """The ranges of keys (from_key, to_key) in which two hash trees differ, with their rows before and after; null keys have a null range."""
    a, b = (t.where("level = 0").select("node", F.col("n").alias(f"n_{x}"), F.col("digest").alias(f"d_{x}")) for t, x in ((before, "before"), (after, "after")))
    off = a.join(b, "node", "full_outer").where(~F.col("d_before").eqNullSafe(F.col("d_after")))
    key = lambda c: F.when(F.col("node") >= 0, c)
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return off.select(key(F.col("node") * leaf_keys).alias("from_key"), key((F.col("node") + 1) * leaf_keys - 1).alias("to_key"), known("n_before"), known("n_after"))


def snapshot_markers(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and highest key of each table."""
    out = None
    for name, (df, key) in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.max(key).cast("string").alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


def regressed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Markers that went backwards from one snapshot to the next: a reason not to publish."""
    j = before.alias("b").join(after.alias("a"), "table_name", "full_outer")
    return j.where("a.n IS NULL OR a.n < b.n OR a.newest < b.newest").select("table_name", F.col("b.n").alias("before"), F.col("a.n").alias("after"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """added, removed or changed for each key that differs, nulls equal to nulls."""
    b, a = before.select(key, F.struct(*columns).alias("b")), after.select(key, F.struct(*columns).alias("a"))
    j = b.join(a, key, "full_outer")
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(key, state.alias("state")).where("state IS NOT NULL")


def stratified_sample(rows: DataFrame, stratum: str, key: str, most: int = 15) -> DataFrame:
    """The first ``most`` rows of each stratum in the order of the key's hash."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256)))).where(F.col("_r") <= most).drop("_r")


def stride_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """About ``n`` rows at even steps of the order."""
    ranked = rows.withColumns({"_i": F.row_number().over(W.orderBy(order)) - 1, "_n": F.count("*").over(W.partitionBy())})
    step = F.greatest(F.col("_n") / n, F.lit(1.0))
    return ranked.where(F.floor(F.col("_i") / step) != F.floor((F.col("_i") - 1) / step)).drop("_i", "_n")


def active_learning(rows: DataFrame, score: str, relevance: str, cutoff: float, n: int, key: str) -> DataFrame:
    """The n least certain rows: near a sentiment boundary or near the relevance cutoff."""
    near = F.greatest(1 - F.abs(F.abs(score) - 0.05), 1 - F.abs(F.col(relevance) - cutoff))
    return rows.withColumn("uncertainty", near).where("uncertainty IS NOT NULL").orderBy(F.desc("uncertainty"), key).limit(n)


#: Similarity that is high, the two decision thresholds of clustering, and the band around them.
HIGH_SIMILARITY, DECISIONS, BAND = 0.8, (0.30, 0.60), 0.08


def review_strata(groups: DataFrame, members: DataFrame) -> DataFrame:
    """stratum and group_key of every group in each of seven strata that it belongs to.

    A group's similarity is its weakest link: the least of members that are not seeds.
    """
    linked = F.col("match_rule") != "seed"
    links = members.groupBy("group_key").agg(
        F.min(F.when(F.coalesce(linked, F.lit(True)), F.col("similarity"))).alias("similarity"),
        F.max(F.col("match_rule") == "entity+family+time+title").alias("_entity"),
        F.max(F.col("match_rule") == "family+time+title_only").alias("_title"),
    )
    s = F.col("similarity")
    near = F.lit(False)
    for d in DECISIONS:
        near |= F.abs(s - d) <= BAND
    n, sources = F.coalesce("headline_count", F.lit(0)), F.coalesce("source_count", F.lit(0))
    conditions = {
        "multi_source": sources > 1,
        "multi_headline_single_source": (n > 1) & (sources <= 1),
        "high_similarity": s >= HIGH_SIMILARITY,
        "threshold_near": near,
        "entity_based": F.col("_entity"),
        "title_only": F.col("_title"),
        "cross_session": F.coalesce("signal_date_span", F.lit(1)) > 1,
    }
    strata = F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))
    return groups.join(links, "group_key", "left").select(F.explode(strata).alias("stratum"), "group_key", "similarity")


def review_draw(groups: DataFrame, members: DataFrame, most: int = 15, seeds: DataFrame | None = None) -> DataFrame:
    """The first ``most`` groups of each stratum in the order of their hashed keys; with ``seeds``, the closest near misses too."""
    drawn = stratified_sample(review_strata(groups, members), "stratum", "group_key", most)
    if seeds is None:
        return drawn
    missed = near_miss_pairs(seeds, most).select(F.lit("near_miss_pair").alias("stratum"), "group_key", "similarity")
    return drawn.select("stratum", "group_key", "similarity").unionByName(missed)


def near_miss_pairs(seeds: DataFrame, most: int = 15, least: float = NEAR_MISS) -> DataFrame:
    """The ``most`` closest pairs of groups that could have merged and did not: group_key, comparison_group_key, similarity.

    ``seeds`` (group_key, family, session, tokens) are groups of one headline; those
    of the same family and session are compared, if both are known.  A group goes
    with the most similar of those behind it in the order of hashed keys, if
    that is ``least`` similar.  Of groups with equal tokens each goes with the next
    one, and the last with the most similar of other tokens, so copies are never paired.
    """
    x = seeds.where("family IS NOT NULL AND session IS NOT NULL").select(F.col("group_key").alias("id"), "family", "session", "tokens")
    members, links = overlap_links(x, x, 1, ["family", "session"], least)
    order = lambda c: F.sha2(F.col(c).cast("string"), 256)
    placed = written(members.select("id", "rep", order("id").alias("o")).withColumn("next", F.lead("id").over(W.partitionBy("rep").orderBy("o"))))
    copies = placed.where("next IS NOT NULL").select(F.col("id").alias("group_key"), F.struct(F.col("next").alias("b"), F.lit(1.0).alias("jaccard")).alias("x"))
    ends = placed.where("next IS NULL").select(F.col("id").alias("group_key"), F.col("rep").alias("a"), F.col("o").alias("after"))
    met = ends.join(both_ways(links), "a").select("group_key", "after", F.col("b").alias("rep"), "jaccard").join(placed.select("id", "rep", "o"), "rep").where("after < o")
    best = met.groupBy("group_key").agg(F.min_by(F.struct(F.col("id").alias("b"), "jaccard"), F.struct(F.negative("jaccard"), "o")).alias("x")).unionByName(copies)
    out = best.select("group_key", F.col("x.b").alias("comparison_group_key"), F.round("x.jaccard", 4).alias("similarity"))
    return out.orderBy(F.desc("similarity"), order("group_key")).limit(most)


def review_sheet(groups: DataFrame, mappings: DataFrame, headlines: DataFrame) -> DataFrame:
    """Each mapped headline of ``groups`` with its source: what a reviewer reads."""
    listed = mappings.join(groups, "group_key", "left_semi")
    return listed.join(headlines.select(F.col("id").alias("headline_id"), "source", "label"), "headline_id")


def readiness(sessions: DataFrame, outcomes: DataFrame, least: int) -> DataFrame:
    """One row: sessions, those with an outcome, families, unknown scores and times, and whether there is enough to begin."""
    rows = sessions.join(outcomes, "session", "left")
    known = F.count_distinct(F.when(F.col("outcome").isNotNull(), F.col("session")))
    return rows.agg(
        F.count_distinct("session").alias("sessions"),
        known.alias("outcomes"),
        F.count_distinct("family").alias("families"),
        F.count_if(F.col("score").isNull()).alias("unscored"),
        F.count_if(F.col("published_ts").isNull()).alias("untimed"),
        F.count_if(F.col("outcome").isNull()).alias("blocked_no_outcome"),
        (known >= least).alias("ready"),
    )
