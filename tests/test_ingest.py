"""Versioned tables, the cursor source and settlement by timers."""

import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import cursor, sinks
from tidemark.sources.snapshots import Conflict, SnapshotTable


def rows(spark, *values, schema="k int, v string, n int"):
    return spark.createDataFrame(list(values), schema)


def test_versions_stay_readable(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.manifest() is None and t.versions() == []
    with pytest.raises(ValueError):
        t.read()
    assert t.insert_ignore(rows(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)), ["k"], "n") == 3
    assert t.insert_ignore(rows(spark, (2, "x", 1), (None, "y", 1)), ["k"], "n") == 0
    t.insert_or_replace(rows(spark, (1, "z", 9)), ["k"], "n")
    t.prune("v", "z")
    got = lambda v=None: sorted(tuple(r) for r in t.read(v).where("k IS NOT NULL").collect())
    assert t.versions() == [1, 2, 3]
    assert got(1) == [(1, "a", 1), (2, "c", 1)] and got(2) == [(1, "z", 9), (2, "c", 1)] and got() == [(1, "z", 9)]
    assert t.restore(1) == 4 and got() == got(1)
    assert [r["operation"] for r in t.history().orderBy("version").collect()] == ["insert_ignore", "insert_or_replace", "prune", "restore 1"]
    with pytest.raises(ValueError):
        t.read(9)
    assert t.expire(keep=1) == 2 and t.versions() == [4] and got() == [(1, "a", 1), (2, "c", 1)]


def test_columns_are_only_added(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, (1, "a"), schema="k int, v string"))
    t.append(rows(spark, (2, "b", 5)))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, "b", 5)]
    with pytest.raises(ValueError):
        t.append(rows(spark, ("x", "b"), schema="k string, v string"))


def test_of_two_commits_one_comes_first_and_none_is_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    SnapshotTable(spark, path).append(rows(spark, (0, "a", 0)))
    failed = []

    def work(i):
        try:
            SnapshotTable(spark, path).insert_ignore(rows(spark, (7, "same", i), (i, "own", i)), ["k"], "n")
        except Conflict as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = sorted(r["k"] for r in sinks.read(spark, path).collect())
    assert not failed and got == [0, 1, 2, 3, 7]


def test_a_reader_sees_one_version_while_others_are_written(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.rebuild(spark.range(100).withColumn("v", F.lit(0)))
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            r = t.read().agg(F.count("*"), F.count_distinct("v")).first()
            seen.append(tuple(r))

    reader = threading.Thread(target=look)
    reader.start()
    before = t.read()
    for v in (1, 2, 3):
        t.rebuild(spark.range(100).withColumn("v", F.lit(v)))
    stop.set()
    reader.join()
    assert len(seen) > 0 and set(seen) == {(100, 1)}
    assert {r["v"] for r in before.collect()} == {0}


def test_a_failed_commit_leaves_the_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.rebuild(spark.range(3))
    with pytest.raises(Exception, match="stop"):
        t.rebuild(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id")))
    assert t.versions() == [1] and t.read().count() == 3


def test_a_batch_is_committed_once(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.append(spark.range(3), batch=("q", 0)) == 3 and t.append(spark.range(3), batch=("q", 0)) == 0
    assert t.append(spark.range(2), batch=("q", 1)) == 2 and t.append(spark.range(2), batch=("r", 0)) == 2
    assert t.read().count() == 7


def detail(i, **more):
    return {"disclosureIndex": i, "disclosureType": "ODA", "disclosureClass": "X", "time": "29.12.2023 18:23:08", "senderTitle": f"c{i}", "summary": {"tr": f"s{i}"}} | more


def land(folder, details, page_size=10, name="a"):
    for d in details:
        at = folder / f"page={d['disclosureIndex'] // page_size}"
        at.mkdir(parents=True, exist_ok=True)
        with open(at / f"{name}.txt", "a", encoding="utf-8") as f:
            f.write(json.dumps(d) + "\n")


def drain(spark, tmp_path, checkpoint="cp", out="out", **options):
    """One run: a batch of what is past the cursor."""
    stream = cursor.read_pages(spark, str(tmp_path / "landed"), str(tmp_path / "cursor"), page_size=10, **options)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / checkpoint)).option("path", str(tmp_path / out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r[0] for r in spark.read.schema(cursor.SCHEMA).parquet(str(tmp_path / out)).collect())


def test_cursor_is_seeded_capped_and_never_goes_back(spark, tmp_path):
    land(tmp_path / "landed", [detail(i) for i in (3, 5, 17)])
    assert drain(spark, tmp_path, maxDetails=3) == []  # the first run seeds the cursor
    land(tmp_path / "landed", [detail(i) for i in (18, 19, 21, 40, 44)], name="b")
    assert drain(spark, tmp_path, maxDetails=3) == [18, 19, 21]
    assert drain(spark, tmp_path, maxDetails=3) == [18, 19, 21, 40, 44]
    assert drain(spark, tmp_path, maxDetails=3) == [18, 19, 21, 40, 44]
    land(tmp_path / "landed", [detail(4), detail(45)], name="c")  # one lands late, behind the cursor
    assert drain(spark, tmp_path, maxDetails=3) == [18, 19, 21, 40, 44, 45]


def test_a_lost_checkpoint_reads_on_from_the_own_cursor(spark, tmp_path):
    land(tmp_path / "landed", [detail(i) for i in range(7)])
    assert drain(spark, tmp_path, maxDetails=4, startingIndex=0) == [0, 1, 2, 3]
    assert drain(spark, tmp_path, maxDetails=4, startingIndex=0) == [0, 1, 2, 3, 4, 5, 6]
    assert drain(spark, tmp_path, maxDetails=4, startingIndex=0) == [0, 1, 2, 3, 4, 5, 6]
    land(tmp_path / "landed", [detail(8)], name="d")
    assert set(drain(spark, tmp_path, checkpoint="cp2", out="out2", maxDetails=4)) >= {8}
    assert not {0, 1, 2, 3} & set(drain(spark, tmp_path, checkpoint="cp2", out="out2", maxDetails=4))


def test_details_become_events(spark):
    payloads = [detail(1), detail(2, summary={"tr": " "}, subject={"tr": "subject"}, relatedStocks=[{"code": "AAA"}, {"code": ""}, {}]), detail(3, time="soon"), detail(4, senderTitle=None, summary=None, behalfSenderTitle=None)]
    df = spark.createDataFrame([(p["disclosureIndex"], json.dumps(p)) for p in payloads] + [(9, "{broken")], cursor.SCHEMA)
    got = {r["external_id"]: r for r in cursor.disclosure_events(df).collect()}
    assert sorted(got) == ["disclosure:1", "disclosure:2", "disclosure:4"]
    assert got["disclosure:1"]["title"] == "c1: s1" and got["disclosure:1"]["published_ts"] == datetime(2023, 12, 29, 18, 23, 8)
    assert got["disclosure:2"]["title"] == "c2: subject" and got["disclosure:2"]["tickers"] == ["AAA"]
    assert got["disclosure:4"]["title"] == "?: ODA" and got["disclosure:4"]["event_type"] == "ODA/X"


CALENDAR = [("2024-01-15", True, 65_400), ("2024-01-16", True, 65_400), ("2024-01-19", True, 46_800), ("2024-01-20", False, 65_400)]


@pytest.fixture
def calendar(spark):
    return spark.createDataFrame(CALENDAR, "date string, is_trading boolean, close_sec int").withColumn("date", F.to_date("date"))


def fetch(day, at, close=10.0, volume=5.0):
    return {"date": day, "open": 9.0, "high": 12.0, "low": 8.0, "close": close, "volume": volume, "fetched_at": at}


FETCH = "date date, open double, high double, low double, close double, volume double, fetched_at timestamp"


def test_fetches_are_classified(spark, calendar):
    data = [
        fetch("2024-01-15", "2024-01-15 12:00:00"), fetch("2024-01-15", "2024-01-15 18:39:59"), fetch("2024-01-15", "2024-01-15 18:40:00"), fetch("2024-01-19", "2024-01-19 13:30:00", volume=0.0),
        fetch("2024-01-20", "2024-01-21 12:00:00"), fetch("2024-01-15", None), fetch("2024-01-16", "2024-01-17 00:00:00", close=50.0), fetch("2024-01-15", "2024-01-16 00:00:00", volume=None), fetch("2031-01-01", "2031-01-02 00:00:00"),
    ]
    df = spark.read.schema(FETCH).json(spark.sparkContext.parallelize([json.dumps(x) for x in data], 1))
    from tidemark.streaming import settlement

    got = [(r["bar_status"], r["review"]) for r in settlement.classified(df.withColumn("i", F.monotonically_increasing_id()), calendar).orderBy("i").collect()]
    assert got == [
        ("provisional", None), ("provisional", None), ("complete", None), ("complete", "zero_volume_half"), ("provider_invalid", "non_trading_day"),
        ("provisional", None), ("provider_invalid", None), ("complete", "missing_volume_full"), ("provider_invalid", "non_trading_day"),
    ]


def test_bars_settle_by_timers_and_corrections_stay(spark, calendar, tmp_path):
    import os

    from tidemark.streaming import settlement

    batches = [
        [fetch("2024-01-15", "2024-01-15 12:00:00", 9.5)],
        [fetch("2024-01-15", "2024-01-15 18:45:00", 10.0), fetch("2024-01-16", "2024-01-16 12:00:00", 11.0)],  # the watermark passes the 15th's settlement
        [fetch("2024-01-15", "2024-01-16 13:00:00", 10.0), fetch("2024-01-16", "2024-01-17 12:00:00", 11.0)],  # the 15th again, as it was
        [fetch("2024-01-15", "2024-01-18 12:00:00", 10.5), fetch("2024-01-19", "2024-01-19 12:00:00", 8.5)],  # a correction
        [fetch("2024-01-15", "2024-01-15 13:00:00", 1.0), fetch("2024-01-20", "2024-01-21 12:00:00", 8.5)],  # late and unsettled: dropped by the watermark; no session
        [fetch("2024-01-16", "2024-01-22 12:00:00", 11.0)],  # now the 19th's timer goes off
        [fetch("2024-01-19", "2024-01-22 13:00:00", 8.7)],  # settles late
    ]
    src = tmp_path / "src"
    src.mkdir()
    for n, rows_ in enumerate(batches):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows_)))
        os.utime(src / f"{n}.json", (1_700_000_000 + n * 60,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", settlement.STATE_STORE)
    try:
        stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).json(str(src))
        q = settlement.settled_bars(stream, calendar).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["date"], r["event"], r["close"], r["bar_status"]) for r in out.collect())
    assert got == [
        ("2024-01-15", "corrected", 10.5, "corrected"),
        ("2024-01-15", "settled", 10.0, "complete"),
        ("2024-01-16", "settled", 11.0, "complete"),
        ("2024-01-19", "settled_late", 8.7, "complete"),
        ("2024-01-19", "withheld", 8.5, "provisional"),
        ("2024-01-20", "withheld", 8.5, "provider_invalid"),
    ]
    last = {r["date"]: (r["event"], r["close"]) for r in settlement.latest(out).collect()}
    assert last == {"2024-01-15": ("corrected", 10.5), "2024-01-16": ("settled", 11.0), "2024-01-19": ("settled_late", 8.7), "2024-01-20": ("withheld", 8.5)}


def test_late_rows_rebuild_their_sessions_only(spark, calendar, tmp_path):
    from tidemark.operators.calendar import build_calendar
    from tidemark.streaming import derived

    days = build_calendar(spark, "2024-01-01", "2024-01-31", (), {})
    src = tmp_path / "src"
    src.mkdir()
    item = lambda g, at, score: json.dumps({"source": "s" + g[0], "guid": g, "url": None, "title": "t", "published_ts": at, "score": score})
    schema = "source string, guid string, url string, title string, published_ts timestamp_ntz, score double"

    def go(name, lines, checkpoint="cp"):
        (src / name).write_text("\n".join(lines))
        stream = spark.readStream.schema(schema).json(str(src))
        derived.maintain_sessions(stream, days, str(tmp_path / "items"), str(tmp_path / "sessions"), str(tmp_path / checkpoint)).awaitTermination()
        return {str(r["signal_date"]): (r["n_items"], r["mean_score"], r["items_version"]) for r in SnapshotTable(spark, str(tmp_path / "sessions")).read().collect()}

    a, b, c = item("a1", "2024-01-15T11:00:00", 0.5), item("b1", "2024-01-16T11:00:00", 1.0), item("c1", "2024-01-15T12:00:00", -0.5)
    assert go("1.json", [a, b, a]) == {"2024-01-15": (1, 0.5, 1), "2024-01-16": (1, 1.0, 1)}
    # a day later one comes for the 15th; the 16th stays as it was
    assert go("2.json", [c, a]) == {"2024-01-15": (2, 0.0, 2), "2024-01-16": (1, 1.0, 1)}
    # all again, from another checkpoint: nothing is added
    got = go("3.json", [c], checkpoint="cp2")
    assert {k: v[:2] for k, v in got.items()} == {"2024-01-15": (2, 0.0), "2024-01-16": (1, 1.0)}


def test_watermarked_aggregates(spark, tmp_path):
    from tidemark.streaming import ingest

    src = tmp_path / "src"
    src.mkdir()
    rows_ = [("a", "2024-01-15T10:00:00"), ("a", "2024-01-15T10:30:00"), ("b", "2024-01-15T11:00:00"), ("c", "2024-01-16T09:00:00")]
    (src / "1.json").write_text("\n".join(json.dumps({"source": "s", "guid": g, "url": None, "title": "t", "published_ts": at, "score": 1.0, "category": "x"}) for g, at in rows_))
    stream = spark.readStream.schema("source string, guid string, url string, title string, published_ts timestamp, score double, category string").json(str(src))

    def last(df, name, mode):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert last(ingest.deduplicated(stream).select("guid"), "deduplicated_items", "append").count() == 3
    daily = last(ingest.daily_windows(stream), "daily_items", "complete")
    assert sorted((r["category"], r["n"]) for r in daily.collect()) == [("x", 1), ("x", 3)]


def test_values_that_may_be_zero_are_no_invalid_prices(spark, calendar):
    from tidemark.streaming import settlement

    df = spark.createDataFrame([("2024-01-15", 1.0, 2.0, 0.0, 0.0, 5.0, "2024-01-16 12:00:00")], "date string, open double, high double, low double, close double, volume double, fetched_at string")
    df = df.withColumns({"date": F.to_date("date"), "fetched_at": F.col("fetched_at").cast("timestamp")})
    assert [settlement.classified(df, calendar, positive=p).first()["bar_status"] for p in (True, False)] == ["provider_invalid", "complete"]
