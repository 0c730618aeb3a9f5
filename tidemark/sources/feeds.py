"""Landed feeds and provider payloads as frames: RSS and Atom, HTML listings, JSON maps and timelines, CSV.

Nothing here opens a connection; a fetcher lands bytes, and these read them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import disclosure_title, parse_published, strip_cdata

def decode_bytes(content: Column) -> Column:
    """Text of feed bytes: UTF-8 where valid, else Latin-1 with the six letters in which the Turkish sets differ from it.

    ISO-8859-9 and windows-1254 are Latin-1 but for these letters, so one
    translation decodes both, without Python; bytes that the XML declaration
    calls ISO-8859-1 keep them.
    """
    latin = F.decode(content, "ISO-8859-1")
    named = F.lower(F.regexp_extract(latin, "encoding=[\"']([A-Za-z0-9-]+)", 1))
    turkish = F.translate(latin, "ÐÝÞðýþ", "ĞİŞğış")
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(named == "iso-8859-1", latin).otherwise(turkish)
    return F.regexp_replace(text, "^\ufeff", "")


_ITEM = "struct<title:string,link:array<struct<_VALUE:string,_href:string>>,guid:string,id:string,pubDate:string,published:string,updated:string,date:string>"
#: Where RSS 2.0 (with or without a channel) and Atom have their items; dc:date is read as date.
FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, _corrupt_record string"


def _loose_items(xml: Column) -> Column:
    """Items of a document that is no XML, as an unescaped & makes it: the text between their tags."""
    blocks = F.regexp_extract_all(xml, F.lit("(?s)<(?:item|entry)(?:\\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    tag = lambda b, name: F.trim(strip_cdata(F.regexp_extract(b, f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)))
    href = lambda b: F.regexp_extract(b, "<link[^>]*href=[\"']([^\"']+)", 1)
    names = ("guid", "id", "pubDate", "published", "updated")
    return F.transform(blocks, lambda b: F.struct(tag(b, "title").alias("title"), F.array(F.struct(tag(b, "link").alias("_VALUE"), href(b).alias("_href"))).alias("link"), *[tag(b, n).alias(n) for n in names], tag(b, "dc:date").alias("date")))


_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _cut(feeds: DataFrame, xml: str, least: int = 100_000, most: int = 200) -> DataFrame:
    """(source, _xml): documents of more than ``least`` characters as documents of up to ``most`` items each, the others whole.

    Spark's reader copies an array with each item it adds, so the time for a document
    grows with the square of its items.  A document is cut where that cannot change
    its items: it is XML 1.0 without a document type, each item is an element whose tags
    no comment, section or other item holds, and a document with one item in place of each
    run of items has all these where items are read.  Others stay whole.
    """
    item = lambda name: f"<{name}(?:\\s[^>]*)?(?<!/)>.*?</{{}}>\\s*"
    run = f"(?s){item('(item|entry)').format('\\1')}(?:{item('\\1').format('\\1')})"
    tag = F.lit("(?i)</?(?:[^\\s<>/:]+:)?(?:item|entry)(?=[\\s/>])")
    col, parsed = F.col(xml), F.from_xml("_short", FEED, _XML)
    d = feeds.select("source", col.alias("_xml"), F.when(F.length(col) > least, col).alias("_long"))
    d = d.withColumn("_n", F.regexp_count("_long", F.lit(f"(?s){item('(item|entry)').format('\\1')}")))
    plain = F.regexp_replace("_long", "(?s)<(?:!\\[CDATA\\[.*?\\]\\]|!--.*?--|\\?.*?\\?)>", "")
    clear = (F.col("_n") > most) & ~F.rlike("_long", F.lit("<!DOCTYPE|^\\s*<\\?xml[^>]*1\\.1")) & (F.regexp_count("_long", tag) == F.col("_n") * 2) & (F.regexp_count(plain, tag) == F.col("_n") * 2)
    d = d.withColumn("_short", F.when(clear, F.regexp_replace("_long", f"{run}*+", "<$1><id>1</id></$1>")))
    d = d.withColumn("_s", F.when(F.col("_short").isNotNull(), parsed))
    placed = F.size(F.coalesce("_s.channel.item", "_s.item", "_s.entry")) == F.regexp_count("_short", F.lit("<(?:item|entry)>"))
    whole = F.from_xml("_long", "_none string, _corrupt_record string", _XML)
    d = d.withColumn("_w", F.when(F.col("_s._corrupt_record").isNull() & placed, whole))
    sound = F.col("_w").isNotNull() & F.col("_w._corrupt_record").isNull()
    parts = F.transform(F.regexp_extract_all("_long", F.lit(f"{run}{{0,{most - 1}}}+"), F.lit(0)), lambda x: F.concat(F.lit("<feed>"), x, F.lit("</feed>")))
    d = d.select("source", F.when(sound, parts).otherwise(F.array("_xml")).alias("_parts"))
    return d.select("source", F.explode_outer("_parts").alias("_xml"))


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS 2.0 and Atom documents (source, xml): source, title, url, guid, published_raw, published_ts, published_date, has_time, is_xml.

    Spark's XML reader parses the documents; of those that are no XML, items are
    found by their tags, so that one stray character does not cost a feed, and
    is_xml is false.  Null and empty documents have no items.
    """
    return _items(_cut(feeds, xml))


def _items(feeds: DataFrame) -> DataFrame:
    good = F.col("_f._corrupt_record").isNull()
    items = F.when(good, F.coalesce("_f.channel.item", "_f.item", "_f.entry")).otherwise(_loose_items(F.col("_xml")))
    # what a row keeps of its document stands before the explosion, which copies it into each row; the outer form parses once, as no filter on sizes goes below it
    rows = feeds.withColumn("_f", F.from_xml("_xml", FEED, _XML)).select("source", good.alias("is_xml"), items.alias("_items"))
    rows = rows.select("source", "is_xml", F.posexplode_outer("_items").alias("_i", "b")).where("_i IS NOT NULL")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    field = lambda name: text(F.col(f"b.{name}"))
    links = F.transform("b.link", lambda x: F.coalesce(text(x["_VALUE"]), text(x["_href"])))
    out = rows.select(
        "source",
        field("title").alias("title"),
        F.get(F.array_compact(links), F.lit(0)).alias("url"),
        F.coalesce(field("guid"), field("id")).alias("guid"),
        F.coalesce(*map(field, ("pubDate", "published", "updated", "date"))).alias("published_raw"),
        "is_xml",
    )
    when, has_time = parse_published(F.col("published_raw"))
    return out.withColumns({"published_ts": F.when(has_time, when), "published_date": F.to_date(when), "has_time": has_time})


def scan_feeds(items: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """(items since a date, the first of each URL by time and title, those without a URL all; counters of each source)."""
    # items without a URL are groups of their own by a number, given before the filter, so that times are parsed once
    recent = items.withColumn("_k", F.monotonically_increasing_id()).where(F.col("published_date") >= since)
    order = F.struct(F.col("published_date"), F.coalesce("published_ts", F.col("published_date").cast("timestamp_ntz")), "source", F.coalesce("title", F.lit("")))
    alone = F.when(F.col("url").isNull(), F.col("_k")).alias("_alone")
    kept = recent.groupBy("url", alone).agg(F.min_by(F.struct(*items.columns), order).alias("x")).select("x.*")
    counters = items.groupBy("source").agg(
        F.count("*").alias("found"), F.count_if(F.col("published_date") >= since).alias("recent"), F.count_if(F.col("title").isNull()).alias("untitled"), F.count_if(F.col("published_date").isNull()).alias("undated"), F.count_if(~F.col("is_xml")).alias("not_xml")
    )
    return kept, counters


def html_listing(pages: DataFrame, patterns: Sequence[str], column: str = "html") -> DataFrame:
    """(url, title) of article links by the first pattern, of alternates with two groups, that a page matches."""
    found = [F.arrays_zip(F.regexp_extract_all(column, F.lit(p), F.lit(1)).alias("url"), F.regexp_extract_all(column, F.lit(p), F.lit(2)).alias("title")) for p in patterns]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])
    return pages.select("*", F.explode(first).alias("_l")).select(*[c for c in pages.columns if c not in (column, "url")], F.col("_l.url").alias("link"), F.trim("_l.title").alias("title"))


def fx_rates(payloads: DataFrame, column: str = "json", until: str | None = None) -> DataFrame:
    """A map of date to open, high, low and close as rows."""
    m = F.from_json(column, "map<string,struct<open:double,high:double,low:double,close:double>>")
    out = payloads.select(F.explode(m).alias("d", "v")).select(F.expr("try_cast(d AS date)").alias("date"), "v.*").where("date IS NOT NULL")
    return out.where(F.col("date") <= until) if until else out


def timeline(payloads: DataFrame, series: str, column: str = "json") -> DataFrame:
    """Points of timeline responses as a long series, one value a day."""
    t = F.from_json(column, "struct<timeline:array<struct<data:array<struct<date:string,value:double>>>>>")
    points = payloads.select(F.explode(F.flatten(F.transform(t["timeline"], lambda x: x["data"]))).alias("p"))
    day = F.to_date(F.substring("p.date", 1, 8), "yyyyMMdd")
    return points.select(day.alias("date"), F.lit(series).alias("series"), F.col("p.value").alias("value")).groupBy("date", "series").agg(F.avg("value").alias("value"))


def wide_to_long(wide: DataFrame, date: str = "date", partial: str = "isPartial") -> DataFrame:
    """Search interest: one column a term to long rows; partial periods go."""
    if partial in wide.columns:
        wide = wide.where(~F.col(partial)).drop(partial)
    return wide.unpivot(date, [c for c in wide.columns if c != date], "series", "value")


def disclosures(rows: DataFrame) -> DataFrame:
    """Disclosure records (id, company, summary, subject, published) as headlines; times are day first."""
    when = F.try_to_timestamp("published", F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz")
    return rows.select("id", disclosure_title(F.col("company"), F.col("summary"), F.col("subject")).alias("title"), when.alias("published_ts"), F.to_date(when).alias("published_date"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; a byte order mark before the first name goes."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def missing_keys(fetched: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Backfill: fetched rows whose key is not stored yet."""
    return fetched.join(existing.select(*keys), list(keys), "left_anti")


def rename_aliases(df: DataFrame, aliases: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Known aliases to their names, and an error for required columns that are still missing."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
