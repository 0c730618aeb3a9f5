import json
import os
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core, text
from tidemark.operators import history, reports
from tidemark.schemas import SCHEMAS, conform
from tidemark.sources import feeds, sinks
from tidemark.streaming import ingest


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_fold(spark):
    assert one(spark, "  İSTANBUL  Çağrı\tŞÜ ", text.fold) == "istanbul cagri su"
    assert one(spark, "Ég è̀ ſ", text.fold_marks) == "eg e s"


def test_word_bounds(spark):
    f = lambda x: text.mentions(x, "thy")
    assert one(spark, "healthy", f) is False and one(spark, "thy name", f) is True


def test_rule_order(spark):
    rule = lambda x: text.relevance_rule(x, ["hard"], ["strong"], ["soft"], ["key"])
    assert [one(spark, t, rule) for t in ("strong hard", "strong soft", "soft key", "key", "none")] == ["hard_blocklist", None, "soft_blocklist", None, "no_keyword"]


def test_published_times(spark):
    def parse(x):
        when, has = core.parse_published(x)
        return F.struct(when.alias("w"), has.alias("h"))

    cases = {
        "Mon, 15 Jan 2024 10:30:00 +0300": (datetime(2024, 1, 15, 10, 30), True),
        "2024-01-15T07:30:00Z": (datetime(2024, 1, 15, 10, 30), True),
        "15.01.2024 10:30": (datetime(2024, 1, 15, 10, 30), True),
        "2024-01-15": (datetime(2024, 1, 15), False),
        "nonsense": (None, False),
    }
    assert {t: tuple(one(spark, t, parse)) for t in cases} == cases


def test_observation_key_ignores_titles_when_there_is_a_guid(spark):
    rows = spark.createDataFrame([("s", "g", "u", "t1"), ("s", "g", "v", "t2"), ("s", " ", "u", "t1"), ("s", None, None, "t1")], "s string, g string, u string, t string")
    keys = [r[0] for r in rows.select(core.observation_key(F.col("s"), F.col("g"), F.col("u"), F.col("t"), F.lit("2024"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_score_tuple(spark):
    rows = spark.createDataFrame([("positive", 0.01), ("negative", 3.0), ("neutral", 0.9), ("odd", 1.0)], "l string, s double")
    got = [r[0] for r in rows.select(core.score_tuple(F.col("l"), F.col("s"))).collect()]
    assert got[0]["score"] == 0.06 and got[1]["score"] == -1.0 and got[2]["p_neutral"] == 1.0 and got[3] is None


def test_attempts(spark):
    a = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False), (2, 1, False), (2, 2, False), (2, 3, True), (3, 0, False)], "id long, seq int, ok boolean")
    got = {r["id"]: (r["failures"], r["status"]) for r in history.fold_attempts(a).collect()}
    assert got == {1: (1, "scored"), 2: (3, "failed"), 3: (1, "retry_pending")}


def test_mixed_experiments_are_refused(spark):
    rows = spark.createDataFrame([("a", "m"), (" ", "m")], "experiment_id string, model_name string")
    with pytest.raises(ValueError, match="mixed"):
        history.guard_single_experiment(rows)


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    assert sinks.insert_ignore(rows, path, ["k"], "n") == 2 and sinks.insert_ignore(rows, path, ["k"], "n") == 0
    sinks.insert_or_replace(spark.createDataFrame([(1, "z", 9)], rows.schema), path, ["k"], "n")
    assert {r["k"]: r["v"] for r in sinks.read(spark, path).collect()} == {1: "z", 2: "c"}
    sinks.prune(spark, path, "v", "z")
    assert sinks.read(spark, path).count() == 1


def test_replace_version_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "v")
    sinks.replace_version(spark.createDataFrame([(1, "v1"), (2, "v2")], "x int, version string"), path, "version")
    sinks.replace_version(spark.createDataFrame([(3, "v2")], "x int, version string"), path, "version")
    assert sorted(tuple(r) for r in sinks.read(spark, path).select("x", "version").collect()) == [(1, "v1"), (3, "v2")]


def test_append_only_and_frozen(spark, tmp_path):
    t = sinks.AppendOnly(str(tmp_path / "a"), ["x"])
    rows = spark.createDataFrame([(1,), (None,)], "x int")
    assert t.append(rows) == 2 and t.append(rows) == 0
    path = str(tmp_path / "f")
    h = sinks.freeze_artifact(spark, {"b": 1, "a": 2}, path, "n", "v1")
    assert sinks.freeze_artifact(spark, {"a": 2, "b": 1}, path, "n", "v1") == h
    with pytest.raises(ValueError):
        sinks.freeze_artifact(spark, {"a": 3}, path, "n", "v1")
    assert sinks.verify_artifacts(spark, path).first()["intact"]


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A & b]]></title><link>http://x/1</link><guid>1</guid><pubDate>Mon, 15 Jan 2024 10:30:00 +0300</pubDate></item><item><title>c</title></item></rss>"
    atom = '<feed><entry><title>d</title><link rel="x" href="http://x/2"/><id>7</id><updated>2024-01-15T07:30:00Z</updated></entry></feed>'
    got = feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom)], "source string, xml string")).collect()
    assert [(r["title"], r["url"], r["guid"]) for r in got] == [("A & b", "http://x/1", "1"), ("c", None, None), ("d", "http://x/2", "7")]
    assert got[0]["published_ts"] == got[2]["published_ts"] == datetime(2024, 1, 15, 10, 30) and not got[1]["has_time"]


def test_decoding(spark):
    rows = spark.createDataFrame([("﻿ğ".encode(),), ("Ağ İş".encode("iso-8859-9"),)], "b binary")
    assert [r[0] for r in rows.select(feeds.decode_bytes(F.col("b"))).collect()] == ["ğ", "Ağ İş"]


def test_payloads(spark, tmp_path):
    t = spark.createDataFrame([(json.dumps({"timeline": [{"data": [{"date": "20240115T000000Z", "value": 2.0}, {"date": "20240115T120000Z", "value": 4.0}]}]}),)], "json string")
    assert [tuple(r) for r in feeds.timeline(t, "tone").collect()] == [(date(2024, 1, 15), "tone", 3.0)]
    p = tmp_path / "x.csv"
    p.write_text("﻿id,v\n1,a\n", encoding="utf-8")
    assert feeds.read_csv(spark, str(p)).first().asDict() == {"id": "1", "v": "a"}


def test_conform_and_reports(spark):
    df = conform(spark.createDataFrame([("2024-01-02", "5")], "date string, close string"), "bars")
    assert dict(df.dtypes) == {n: t.replace("long", "bigint") for n, t in SCHEMAS["bars"].items()} and df.first()["close"] == 5.0
    a, b = (spark.createDataFrame([("t", n, m)], "table_name string, n long, newest string") for n, m in ((5, "b"), (4, "c")))
    assert reports.regressed(a, b).count() == 1 and reports.regressed(b, a.withColumn("newest", F.lit("d"))).count() == 0


def test_stream_ingest_replays_add_nothing(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    line = {"source": "s", "guid": "g", "url": "u", "title": "t", "published_ts": "2024-01-15T10:30:00"}
    schema = "source string, guid string, url string, title string, published_ts timestamp"
    (src / "1.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"title": "again"}) + "\n" + json.dumps(line | {"guid": "h"}))
    go = lambda cp: ingest.append_observations(ingest.keyed(ingest.read_landed(spark, str(src), schema)), out, str(tmp_path / cp)).awaitTermination()
    go("cp")
    (src / "2.json").write_text(json.dumps(line))
    go("cp")
    go("cp2")  # a lost checkpoint replays everything
    assert sinks.read(spark, out).count() == 2


def test_stream_states(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    for n, rows in enumerate(([(1, False, 0), (2, False, 0), (2, False, 1)], [(1, True, 1), (2, False, 2), (2, True, 3)])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "ok": ok, "seq": s}) for i, ok, s in rows))
        os.utime(src / f"{n}.json", (1_700_000_000 + n * 60,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema("id long, ok boolean, seq int").option("maxFilesPerTrigger", 1).json(str(src))
    q = ingest.attempt_states(stream).writeStream.outputMode("update").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("attempts").collect():
        last[r["id"]] = r["status"] if last.get(r["id"]) not in ("scored", "failed") else last[r["id"]]
    assert last == {1: "scored", 2: "failed"}


def feed_rows(items):
    return sorted(tuple(map(str, r)) for r in items.collect())


def test_a_long_feed_takes_time_by_its_items_not_by_their_square(spark):
    n = 80_000
    item = F.concat(F.lit("<item><title><![CDATA[a & <b> "), F.col("id"), F.lit("]]></title><link>http://x/"), F.col("id"), F.lit("</link><pubDate>2024-01-15 10:30:00</pubDate></item>\n"))
    body = spark.range(n).select(item.alias("x")).agg(F.array_join(F.collect_list("x"), "").alias("x"))
    wrapped = lambda before: F.concat(F.lit(f"<rss><channel><title>{before}</title>"), "x", F.lit("</channel></rss>"))
    docs = body.select(F.lit("r").alias("source"), wrapped("t").alias("xml")).union(body.select(F.lit("broken"), wrapped("AT&T"))).repartition(2).localCheckpoint()
    assert sorted(r["count"] for r in feeds._cut(docs, "xml").groupBy("source").count().collect()) == [1, n // 200]
    began = time.monotonic()
    got = feeds.feed_items(docs).groupBy("source", "is_xml").agg(F.count("*"), F.count_distinct("title"), F.count_distinct("url"), F.count("published_ts"))
    assert sorted(map(tuple, got.collect())) == [("broken", False, n, n, n, n), ("r", True, n, n, n, n)]
    assert time.monotonic() - began < 45


ITEM = "<item><title>{}</title></item>"


@pytest.mark.parametrize(
    "xml, cut",
    [
        ("<rss><channel><title>c</title>" + "".join(map(ITEM.format, range(7))) + "</channel></rss>", True),
        ("<rss>" + "".join(map(ITEM.format, range(3))) + "<!-- a --><x/>" + "".join(map(ITEM.format, range(3))) + "</rss>", True),
        ('<feed xmlns="a">' + "".join(f'<entry a="x>y">\n<id>{i}</id><dc:date>2024-01-15</dc:date><link href="u"/></entry>\n' for i in range(5)) + "</feed>", True),
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "<item/></channel></rss>", False),  # an empty one
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "<x:item><title>p</title></x:item></channel></rss>", False),  # one with a prefix
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "<!-- <item><title>h</title></item> --></channel></rss>", False),
        ("<rss><channel><item><title><![CDATA[</item>]]></title></item>" + "".join(map(ITEM.format, range(4))) + "</channel></rss>", False),
        ("<rss><channel><item><![CDATA[</item><item>]]></item>" + "".join(map(ITEM.format, range(4))) + "</channel></rss>", False),
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "<item>" + ITEM.format("in") + "</item></channel></rss>", False),
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "</channel>" + ITEM.format("elsewhere") + "</rss>", False),
        ("<rss><channel>" + "".join(map(ITEM.format, range(4))) + "<item><title>a</b></title></item></channel></rss>", False),  # no XML, in an item
        ("<rss><channel>AT&T" + "".join(map(ITEM.format, range(4))) + "</channel></rss>", False),
        ("<!DOCTYPE rss><rss><channel>" + "".join(map(ITEM.format, range(4))) + "</channel></rss>", False),
        ("", False),
        (None, False),
    ],
)
def test_a_document_is_cut_only_where_its_items_stay_the_same(spark, xml, cut):
    docs = spark.createDataFrame([("s", xml)], "source string, xml string")
    parts = feeds._cut(docs, "xml", least=0, most=2)
    assert (parts.count() > 1) == cut
    assert feed_rows(feeds._items(parts)) == feed_rows(feeds._items(docs.withColumnRenamed("xml", "_xml")))


def test_a_scan_reads_its_feeds_once_and_keeps_items_without_a_url(spark):
    item = "<item><title>{}</title>{}<pubDate>2024-01-{} 10:30:00</pubDate></item>".format
    link = "<link>http://x/1</link>"
    xml = "<rss>" + item("late", link, 17) + item("first", link, 16) + item("old", link, 14) + item("a", "", 16) + item("a", "", 16) + item("b", "<link> </link>", 14) + "</rss>"
    kept, counters = feeds.scan_feeds(feeds.feed_items(spark.createDataFrame([("s", xml)], "source string, xml string")), "2024-01-15")
    assert kept.columns == ["source", "title", "url", "guid", "published_raw", "is_xml", "published_ts", "published_date", "has_time"]
    assert sorted((r["title"], r["url"]) for r in kept.collect()) == [("a", None), ("a", None), ("first", "http://x/1")]
    assert tuple(counters.first()) == ("s", 6, 4, 0, 0, 0)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
