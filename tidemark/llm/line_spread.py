"""Cross-site boilerplate removal by the distinct-site spread of lines.

Each line's hash gets a HyperLogLog sketch of the sites that carry it; sketches
merge as the aggregation does.  Lines whose estimate is clearly at or over the
threshold are boilerplate, those clearly under are not, and the few in between
get an exact distinct count.  Boilerplate lines go from all documents but the
first that has them.  Spark functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, free_name, table

#: A line on this many sites is boilerplate; lines of fewer words never are, so with 1 only blank ones.
MIN_SITES, MIN_WORDS = 8, 1
#: 2 ** LG_K registers; three standard errors around the threshold count as near.
LG_K, ERRORS = 8, 3.0
#: Boilerplate lines up to this many (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000
#: Up to this many are constants of the expression that looks at the documents; with more, documents are joined with their places.
CONSTANT_LINES = 5_000


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[ \\t\\r]+", " "))


def line_table(docs: DataFrame, key: str, text: str, site: str, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, site, pos, line for each line of min_words words or more, blank lines left out; the narrow table that all counting reads."""
    lines = docs.where(F.col(text) != "").select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"),
    )
    normal = normal_line(F.col("raw"))
    return lines.where((normal != "") & (F.size(F.split(normal, " ")) >= min_words)).select(
        "id", "text_hash", "site", "pos", F.xxhash64(normal).alias("line")
    )


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line: hashes of the lines that min_sites sites or more carry."""
    sketched = durable(
        lines.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
        .where(F.col("sites") >= math.floor(min_sites * (1 - ERRORS * 1.04 / math.sqrt(2**lg_k))))
    )
    sure = math.ceil(min_sites * (1 + ERRORS * 1.04 / math.sqrt(2**lg_k)))
    near = sketched.where(F.col("sites") < sure).select("line")
    exact = (
        lines.join(small(near), "line")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sketched.where(F.col("sites") >= sure).select("line").union(exact.select("line"))


def small(df: DataFrame, most: int = BROADCAST_LINES) -> DataFrame:
    """``df`` with a broadcast hint, if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_places(hits: DataFrame) -> DataFrame:
    """line and first: the first of all places that carry it, as (id is null, id, text_hash, pos)."""
    return hits.groupBy("line").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash", "pos")).alias("first"))


def removals(lines: DataFrame, found: DataFrame) -> DataFrame:
    """id, text_hash, removed: the places of the boilerplate lines ``found`` in each document, but for a line's first place of all."""
    hits = durable(lines.join(small(found), "line").select("line", "id", "text_hash", "pos").distinct())
    is_first = F.expr("id <=> first.id AND text_hash = first.text_hash AND pos = first.pos")
    return (
        hits.join(small(first_places(hits)), "line")
        .where(~is_first)
        .groupBy("id", "text_hash")
        .agg(F.collect_list("pos").alias("removed"))
    )


def removed_by_constants(lines: DataFrame, found: list[int], key: str, text: str) -> Column:
    """What ``removals`` finds, as an expression on a document: hashes of lines and of first places are looked up in sets of constants."""
    if not found:
        return F.lit(None).cast("array<int>")
    first = first_places(lines.where(F.col("line").isin(found)))
    kept = [r[0] for r in first.select(F.xxhash64("line", "first.id", "first.text_hash", "first.pos")).collect()]

    def place(whole: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            line = F.xxhash64(normal_line(raw))
            return F.when(line.isin(found) & ~F.xxhash64(line, F.col(key), whole, i).isin(kept), i)

        return F.array_compact(F.transform(F.split(F.col(text), "\n"), one))

    # the outer transform holds the hash of the whole text, so that it is not taken again for each line
    places = F.get(F.transform(F.array(F.xxhash64(text)), place), F.lit(0))
    return F.when(F.size(places) > 0, places)


def mark_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    lg_k: int = LG_K,
    name: str = "_removed",
) -> DataFrame:
    """``docs`` and ``name``, the places of the lines to take out (null where there are none).

    Only the narrow table of lines is shuffled.  With up to CONSTANT_LINES
    boilerplate lines the documents are mapped where they are; with more, they
    are joined with the places of their own lines.

    Nulls: a null text has no lines; a null site counts as one site; documents
    with a null key come last when a line's first place is sought.  Rows that
    repeat key and text are treated alike.  An empty table gives no rows; other
    columns pass through, whatever their names, but ``name`` must not be among
    them.  One line, site or document may hold any share of the rows: lines are
    counted by partial aggregates, and what is collected per document is bounded
    by its own lines.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"docs has a column {name} already")
    lines = durable(line_table(docs, key, text, site, min_words))
    found = durable(boilerplate_lines(lines, min_sites, lg_k))
    few = [r[0] for r in found.limit(CONSTANT_LINES + 1).collect()]
    if len(few) <= CONSTANT_LINES:
        return docs.withColumn(name, removed_by_constants(lines, few, key, text))
    a, b = free_name(docs, "_id"), free_name(docs, "_hash")
    gone = removals(lines, found).select(F.col("id").alias(a), F.col("text_hash").alias(b), F.col("removed").alias(name))
    same = docs[key].eqNullSafe(gone[a]) & (F.xxhash64(docs[text]) == gone[b])
    return docs.join(gone, same, "left").drop(a, b)


def without_lines(text: Column, removed: Column) -> Column:
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def remove_boilerplate(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; rows stay, and a column n_chars follows the new text.

    Options and special cases as in mark_boilerplate; no column name is reserved.
    """
    name = free_name(docs, "_removed")
    out = mark_boilerplate(docs, text=text, name=name, **options).withColumn(text, without_lines(F.col(text), F.col(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_distinct_site_spread(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    marked = mark_boilerplate(docs)
    cleaned = F.coalesce(without_lines(F.col("text"), F.col("_removed")), F.lit(""))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.char_length(cleaned).cast("long").alias("n_chars_left"),
        F.sha2(cleaned, 256).alias("text_sha256"),
    )


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, coalesce(source, '') AS site, p, trim(regexp_replace(lower(l[p]), '[ \\t\\r]+', ' ', 'g')) AS line
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, text, source, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') x) y
), boiler AS (
  SELECT line FROM lines WHERE line <> '' AND len(string_split(line, ' ')) >= {MIN_WORDS} GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), hits AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k FROM lines JOIN boiler USING (line)
), gone AS (SELECT doc_id, list(p) AS removed FROM hits WHERE k > 1 GROUP BY doc_id),
cleaned AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(len(removed), 0) AS n_removed,
         CASE WHEN removed IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(removed, i)), lambda i: string_split(text, chr(10))[i]), chr(10)), '') END AS left_text
  FROM documents LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(left_text) AS BIGINT) AS n_chars_left, sha256(left_text) AS text_sha256 FROM cleaned
"""
