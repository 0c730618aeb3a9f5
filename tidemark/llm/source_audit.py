"""Source divergence audit with wide term vectors.

The terms of each language are counted per source and pivoted into one wide
vector a term: an array with a place for each source of the language.  JVM
higher-order functions turn a vector into the contributions of its pairs of
sources, which map-side aggregation sums.  The vectors give the terms that a
source uses more than its language does, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, durable, table, tidied

#: A language keeps the terms in so many of its documents at least, and a source reports so many terms.
MIN_DOCS, TOP_TERMS = 10, 10
#: Entries of a task's running counts, before they are sent on.
RUNNING = 400_000
#: Groups (lang, source) that may be broadcast; a result has a row for each pair of a language's sources, so there are not more in any that can be read.
BROADCAST_GROUPS = 200_000

#: Letters A-Z and a-z, and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone, as asked for."""
    return _TERM.findall(text.lower()) if text else []


def named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(known(lang).alias("lang"), known(source).alias("source"), known(text).cast("binary").alias("text"))


def term_counts(docs: DataFrame, running: int = RUNNING) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term.

    Tasks add up what they read and send it on when it has ``running`` entries, so
    a frequent term costs a task few rows.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (times, holders) in counts.items():
                terms = list(times)
                parts = (pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()), pa.array(times.values(), pa.int64()), pa.array(map(holders.__getitem__, terms), pa.int64()))
                for column, part in zip(columns, parts):
                    column.append(part)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = terms_of(text)
                if terms:
                    times, holders = counts.setdefault((lang, source), (Counter(), Counter()))
                    times.update(terms)
                    holders.update(set(terms))
            if sum(len(times) for times, _ in counts.values()) > running:
                yield sent()
        if counts:
            yield sent()

    return bounded_batches(docs).mapInArrow(tidied(run), "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), by long division in two steps: exact for counts up to 9 * 10**13."""
    over, under = (n + 2) * 100_000, total + 2 * kept
    return 1 + F.call_function("div", over, under) * 10_000 + F.call_function("div", (over % under) * 10_000, under)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def places(groups: DataFrame) -> DataFrame:
    """lang, source, at: the place of each source among those of its language, in the order of their names."""
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return listed.select("lang", F.posexplode("sources").alias("at", "source"))


def term_vectors(docs: DataFrame, at: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, counts (place of the source: occurrences, for sources with any) of the terms that a language keeps."""
    counted = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(at, ["lang", "source"])
    vectors = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("counts"))
    return vectors.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "counts")


def profiles(at: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each language: lang, kept (terms), and by place sources, totals (of kept terms) and absent, the share of a term that a source lacks."""
    per_source = vectors.select("lang", F.explode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("kept"))
    known = at.join(per_source, ["lang", "at"], "left").select("lang", F.struct("at", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total")).alias("s"))
    rows = known.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s")).join(kept, "lang", "left")
    n = F.coalesce("kept", F.lit(0)).cast("long")
    # with no terms kept nothing is divided
    absent = F.transform("s", lambda x: F.when(n > 0, share(F.lit(0), x.total, n)).otherwise(1))
    return rows.select("lang", n.alias("kept"), F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), absent.alias("absent"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """How far the sources of a language are apart, and by what terms: lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language; value is the divergence of
    the two, summed over the language's terms.  Part ``term``: the ``top`` terms
    that the source uses more than its language.  Larger values come first, then
    items in the order of their UTF-8 bytes.

    Null text, lang and source count as ''.  A source whose documents have no
    term is compared like any other, at a value of 0 where the language keeps no
    terms; a language of one source has no pairs.  Repeated rows count each; an
    empty table gives no rows; other columns are not read.  A language, source or
    term may hold any share of the rows: tasks pre-aggregate, and what meets in
    one place is a term's vector, which has an entry for each source.
    """
    rows = named(docs, text, lang, source)
    at = durable(places(rows.select("lang", "source").distinct()))
    few = at.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda df: df
    vectors = durable(term_vectors(rows, small(at), min_docs))
    found = durable(profiles(at, vectors))
    wide = vectors.join(small(found), "lang")

    # a place for each source of the language: is the term there, and its share
    place = lambda absent, i: F.struct(
        F.map_contains_key("counts", i).alias("has"),
        F.when(F.map_contains_key("counts", i), share(F.try_element_at("counts", i), F.get("totals", i), F.col("kept"))).otherwise(absent).alias("p"),
    )
    placed = wide.select("lang", F.transform("absent", place).alias("v"))

    # what a term adds to a pair of sources of which one has it at least
    def with_later(x: Column, i: Column) -> Column:
        later = F.transform(F.slice("v", i + 2, F.size("v")), lambda y, k: F.when(x.has | y.has, F.struct(i.alias("i"), (i + 1 + k).alias("j"), divergence(x.p, y.p).alias("d"))))
        return F.filter(later, lambda e: e.isNotNull())

    pairs = placed.select("lang", F.explode(F.flatten(F.transform("v", with_later))).alias("e")).groupBy("lang", "e.i", "e.j").agg(F.sum("e.d").alias("d"), F.count("*").alias("terms"))
    both = pairs.union(pairs.select("lang", "j", "i", "d", "terms"))
    ends = found.select("lang", "kept", "sources", "absent", F.posexplode("sources").alias("i", "source"))
    ends = ends.select("lang", "kept", "absent", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    # and the terms that neither has, which all add the same
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * divergence(F.get("absent", "i"), F.get("absent", "j"))
    apart = ends.join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", (rest + F.coalesce("d", F.lit(0))).cast("long").alias("value"))

    # the same vectors, against the language as a whole
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    q = share(total(F.map_values("counts")), total(F.col("totals")), F.col("kept"))
    more = wide.select("lang", "term", "sources", "totals", "kept", q.alias("q"), F.explode("counts").alias("at", "n"))
    more = more.withColumn("p", share(F.col("n"), F.get("totals", "at"), F.col("kept"))).where("p > q")
    more = more.select("lang", F.get("sources", "at").alias("source"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    out = ranked(apart, "pair").unionByName(ranked(more, "term").where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op12_wide_term_vectors(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), occ AS (SELECT lang, source, r, unnest(w) AS term FROM d),
keep AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN keep k USING (lang) GROUP BY g.lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN keep USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
  FROM tot t JOIN v USING (lang) JOIN keep k ON k.lang = t.lang LEFT JOIN cnt ON cnt.lang = t.lang AND cnt.source = t.source AND cnt.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (n + 2 * v) AS q
  FROM keep k JOIN (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY ALL) USING (lang, term)
  JOIN (SELECT lang, sum(n) AS n FROM tot GROUP BY lang) USING (lang) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
         ON z.lang = a.lang AND z.s = a.source AND z.t = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term
) x WHERE rank <= 10
"""
