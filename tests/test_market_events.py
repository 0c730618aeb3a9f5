import json
import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, events, market, models, pairs, stats


def bars(spark, rows):
    return spark.createDataFrame(rows, "date date, open double, close double, bar_status string")


def test_windows(spark):
    cal = calendar.build_calendar(spark, "2024-01-01", "2024-01-31")
    b = bars(spark, [(date(2024, 1, 2), 10.0, 11.0, "complete"), (date(2024, 1, 3), 12.0, 13.0, "corrected"), (date(2024, 1, 4), 1.0, 1.0, "provisional"), (date(2024, 1, 8), 5.0, 6.0, "complete")])
    e = spark.createDataFrame([("a", date(2024, 1, 3), "pre_open"), ("b", date(2024, 1, 4), "post_close"), ("c", date(2024, 1, 8), "pre_open"), ("d", date(2024, 1, 3), "unknown")], "group_key string, session date, timing_bucket string")
    got = {(r["group_key"], r["window_name"]): r for r in market.return_windows(e, cal, b).collect()}
    assert len(got) == 10
    assert math.isclose(got["a", "gap"]["raw_return"], (12 / 11 - 1) * 100) and got["a", "gap"]["entry_date"] == date(2024, 1, 2)
    assert got["b", "session"]["reason"] == "no_complete_price_bar" and got["b", "session"]["is_available"] == 0
    assert got["c", "gap"]["reason"] == "no_prior_session_bar" and got["c", "session"]["is_available"] == 1
    assert got["d", "gap_and_session"]["is_tradable"] == 0


def test_returns_skip_nulls_and_zeros(spark):
    b = spark.createDataFrame([(date(2024, 1, d), c) for d, c in ((1, 10.0), (2, None), (3, 11.0), (4, 0.0), (5, 3.0))], "date date, close double")
    got = [r["daily_return"] for r in market.daily_returns(b).orderBy("date").collect()]
    assert got[0] is None and got[1] is None and math.isclose(got[2], 10.0) and math.isclose(got[3], -100.0) and got[4] is None


def test_bar_lattice(spark):
    v = spark.createDataFrame([("d", "complete", 1, 5.0), ("d", "provisional", 2, 6.0), ("e", "corrected", 1, 7.0), ("e", "complete", 2, 8.0), ("f", "provisional", 1, 1.0), ("f", "provisional", 2, 2.0)], "date string, bar_status string, fetched_at int, close double")
    assert {r["date"]: r["close"] for r in market.resolve_bars(v).collect()} == {"d": 5.0, "e": 7.0, "f": 2.0}


def test_residuals_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=90) * 0.1
    rows = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i), float(y[i]), float(x[i, 0]), float(x[i, 1]) if i % 9 else None) for i in range(90)], "date date, y double, a double, b double")
    got = {r["date"]: r for r in market.residual_controls(rows, "y", ["a", "b"]).collect()}
    for i in (70, 85):
        use = [j for j in range(i - 60, i) if j % 9]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(use)), x[use]]), y[use], rcond=None)[0]
        r = got[date(2020, 1, 1) + timedelta(days=i)]
        assert r["n_train"] == len(use) and math.isclose(r["fitted"], beta[0] + beta[1:] @ x[i], rel_tol=1e-9)
    assert got[date(2020, 1, 20)]["fitted"] is None and got[date(2020, 3, 22)]["fitted"] is None
    one = market.residual_one_control(rows, "y", "a").where("date = '2020-03-11'").first()
    two = market.residual_controls(rows, "y", ["a"]).where("date = '2020-03-11'").first()
    assert math.isclose(one["fitted"], two["fitted"], rel_tol=1e-9)


def test_residuals_of_three_controls_and_of_one_that_adds_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [1, 100, 0.01] + [5, 1000, 0]
    y = x @ [1.0, 0.02, 30.0] + rng.normal(size=80)
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    rows = spark.createDataFrame([(day(i), float(y[i]), *map(float, x[i]), 7.0, float(2 * x[i, 0])) for i in range(80)], "date date, y double, a double, b double, c double, same double, twice double")
    got = {r["date"]: r for r in market.residual_controls(rows, "y", ["a", "b", "c"]).collect()}
    for i in range(30, 80):
        use = slice(max(0, i - 60), i)
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(y[use])), x[use]]), y[use], rcond=None)[0]
        assert math.isclose(got[day(i)]["fitted"], beta[0] + beta[1:] @ x[i], rel_tol=1e-8)
        assert math.isclose(got[day(i)]["residual"], y[i] - got[day(i)]["fitted"], abs_tol=1e-12)
    assert got[day(29)]["fitted"] is None and got[day(29)]["n_train"] == 29
    one, more = (market.residual_controls(rows, "y", c).where("date = '2020-03-01'").first()["fitted"] for c in (["a"], ["a", "same", "twice"]))
    assert math.isclose(one, more, rel_tol=1e-9)


def cluster_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, family string, moment timestamp_ntz, signal_date date, tokens array<string>, entities array<string>")


def reference_clusters(rows):
    """The sequential rule over all rows at once, for comparison."""
    groups, out = [], {}
    for i, family, moment, day, words, names in sorted(rows):
        if moment is not None:
            groups = [g for g in groups if g["moment"] is None or abs(moment - g["moment"]) <= timedelta(hours=48)]
        best, score = None, 0.0
        for g in groups:
            if g["family"] != family or ((moment is None or g["moment"] is None) and any(d != day for d in g["days"])):
                continue
            a, b = set(words), g["words"]
            j = len(a & b) / len(a | b) if a and b else 0.0
            if j >= (0.3 if set(names) & g["names"] else 0.6) and j > score:
                best, score = g, j
        if best is None:
            best = {"family": family, "moment": moment, "days": set(), "words": set(words), "names": set(), "key": f"{family}:{i}"}
            groups.append(best)
        best["days"].add(day)
        best["names"] |= set(names)
        out[i] = best["key"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clustering_matches_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(700):
        t = datetime(2024, 1, 2) + timedelta(hours=r.random() * 10 * 24) if r.random() < 0.8 else None
        rows.append((i, r.choice("fg"), t, (t or datetime(2024, 1, r.randint(2, 11))).date(), r.sample("abcdef", r.randint(1, 4)), r.sample("XY", r.randint(0, 1))))
    shuffled = r.sample(rows, len(rows))
    for block_rows in (60, 10**6):
        got = {x["id"]: x["group_key"] for x in events.cluster_events(cluster_rows(spark, shuffled), block_rows=block_rows).collect()}
        assert got == reference_clusters(rows)


def test_groups_that_stay_open_cost_no_round_for_each_block(spark, monkeypatch):
    """Groups without a moment stay open to the end here, but none is similar to many rows."""
    r = random.Random(6)
    words = [[f"w{k}", f"x{k}", f"y{k % 40}"] for k in range(80)]
    rows = [(i, r.choice("fg"), None, date(2024, 1, 2), words[i % 80] if i % 9 else [], []) for i in range(400)]
    calls, written = [], events.written
    monkeypatch.setattr(events, "written", lambda df: calls.append(df.columns) or written(df))
    got = {x["id"]: x["group_key"] for x in events.cluster_events(cluster_rows(spark, rows), block_rows=20).collect()}
    assert got == reference_clusters(rows) and calls.count(["lane", "block", "id", "group_key", "similarity", "state"]) == 2


def test_word_index_gives_all_similar_groups_and_few_others():
    r = random.Random(3)
    sets = [set(r.sample(range(400), r.randint(0, 30))) for _ in range(300)]
    index = events.WordIndex([{"words": s, "i": i} for i, s in enumerate(sets)])
    for _ in range(100):
        words = set(r.sample(sorted(r.choice(sets)), 0)) | set(list(r.choice(sets))[:20]) | set(r.sample(range(400), 3))
        got = [g["i"] for g in index.near(words, 0.3)]
        assert got == sorted(got) and {i for i, s in enumerate(sets) if len(s & words) >= 0.3 * len(s | words) and s} <= set(got) and len(got) < 60


def test_groups_without_a_moment_are_forgotten_behind_their_session():
    g = events.OpenGroups()
    g.place("f", 1, 6, False, "2024-01-02", {"a"}, set())
    g.place("f", 2, None, True, "2024-01-02", {"b"}, set())
    assert [x["key"] for x in json.loads(g.state(5))] == ["f:1", "f:2"] and [x["key"] for x in json.loads(g.state(6))] == ["f:2"]


@pytest.mark.parametrize("gap", [1, 997])
def test_close_ids_by_brute_force(spark, gap):
    r = random.Random(gap)
    rows = [(-500 + i * gap, datetime(2024, 1, 2) + timedelta(hours=r.random() * 5 * 24) if r.random() < 0.9 else None) for i in range(400)]
    got = {x["id"]: x["close_id"] for x in events.close_ids(spark.createDataFrame(rows, "id long, moment timestamp_ntz"), 48).collect()}
    far = lambda a, b: abs(int((a - datetime(2024, 1, 1)).total_seconds()) - int((b - datetime(2024, 1, 1)).total_seconds())) > 48 * 3600
    want = {i: next((j for j, u in rows if j > i and t and u and far(t, u)), None) for i, t in rows}
    assert got == want
    assert events.close_ids(spark.createDataFrame([(1, None)], "id long, moment timestamp_ntz")).first()["close_id"] is None


def test_event_timing_and_novelty(spark):
    m = spark.createDataFrame([("g", 3, date(2024, 1, 2), "pre_open"), ("g", 2, date(2024, 1, 3), "post_close"), ("g", 1, date(2024, 1, 3), "unknown")], "group_key string, id long, signal_date date, timing_bucket string")
    r = events.event_timing(m).first()
    assert (r["governing_id"], r["governing_bucket"], r["timing_conflict"]) == (1, "unknown", True)
    g = spark.createDataFrame([("b", "E", 1), ("a", "E", 1), ("c", None, 0)], "group_key string, primary_entity string, first_seen int")
    assert {r["group_key"]: r["novelty"] for r in events.novelty(g).collect()} == {"a": 1.0, "b": 0.5, "c": 1.0}


def test_units_refuse_differing_targets(spark):
    rows = spark.createDataFrame([(1, 0.5, "f", 0.1, 1), (1, 0.6, "f", 0.1, 1)], "session int, target double, family string, tone double, breadth int")
    with pytest.raises(Exception, match="targets differ"):
        events.session_units(rows, "session", "target", ["tone"]).collect()


def test_greedy_equals_sequential(spark):
    r = random.Random(5)
    edges = [(a, 100 + b, r.randint(1, 5)) for a in range(12) for b in range(12) if r.random() < 0.4]
    df = spark.createDataFrame(edges, "a int, b int, w int")
    got = {(x["a"], x["b"]) for x in pairs.greedy_matching(df, [F.desc("w"), "a", "b"]).collect()}
    want, used = set(), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    assert got == want


def test_overlap_pairs_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.sample("abcdefghij", r.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = {(x["a"], x["b"]): x["shared"] for x in pairs.overlap_pairs(df, df, 3).where("a < b").collect()}
    assert got == {(i, j): n for i, a in rows for j, b in rows if i < j and (n := len(set(a) & set(b))) >= 3}


def texts(r, n, copies=0.3):
    rows = []
    for i in range(n):
        words = r.sample([f"w{k}" for k in range(60)], r.randint(0, 12))
        if rows and r.random() < copies:
            words = list(r.choice(rows)[1])
            r.shuffle(words)
        if rows and r.random() < 0.3:
            words = [*r.choice(rows)[1], f"x{i}"]
        rows.append((i, words, r.choice(["s", "t", None])))
    return rows


def similarity(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


@pytest.mark.parametrize("block", [pairs.BLOCK_TOKENS, 2_000])
def test_pairs_of_copies_and_near_copies_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK_TOKENS", block)
    monkeypatch.setattr(pairs, "MAX_FREQUENT", 20)
    monkeypatch.setattr(pairs, "MOST_MET", 50)
    rows = texts(random.Random(block), 150)
    df = spark.createDataFrame(rows, "id long, tokens array<string>, s string")
    got = {(x["a"], x["b"]): (x["shared"], x["jaccard"]) for x in pairs.overlap_pairs(df, df, 2, least_jaccard=0.6).collect()}
    want = {(i, j): (n, x) for i, a, _ in rows for j, b, _ in rows if i != j and (n := len(set(a) & set(b))) >= 2 and (x := similarity(a, b)) >= 0.6}
    assert got == want and len(got) > 50
    near = {x["id"]: (x["nearest"], x["jaccard"]) for x in pairs.nearest_in_bucket(df, ["s"], 0.6).collect()}
    best = {i: max((similarity(a, b), -j) for j, b, t in rows if j != i and t == s) for i, a, s in rows if s and a}
    assert near == {i: (-j, x) for i, (x, j) in best.items() if x >= 0.6}


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Each block is written once, however many others it meets."""
    df = spark.createDataFrame([(i, [f"w{k}" for k in range(i % 50, i % 50 + 12)]) for i in range(300)], "id long, tokens array<string>")
    monkeypatch.setattr(pairs, "BLOCK_TOKENS", 1_500)
    plans, written = {}, pairs.written
    monkeypatch.setattr(pairs, "written", lambda x: plans.update({tuple(x.columns): x._jdf.queryExecution().executedPlan().toString()}) or written(x))
    _, links = pairs.overlap_links(df, df, 1, least_jaccard=0.6)
    want = {frozenset((i, j)) for i in range(50) for j in range(i) if (12 - i + j) / (12 + i - j) >= 0.6}
    assert {frozenset((x["a"], x["b"])) for x in links.collect()} == want
    assert "Exchange" not in plans["a", "b", "side_a", "side_b", "shared", "jaccard"]


def test_few_pairs_are_counted_beside_the_links(monkeypatch):
    """Texts of common words meet nearly all, but few meet in as many tokens as a link needs."""
    r = random.Random(4)
    sets = [sorted({min(int(r.paretovariate(0.7)), 9_000) for _ in range(120)}) for _ in range(300)]
    sets += [x[: int(len(x) * 0.8)] for x in sets[:40]]
    df = Counter(t for x in sets for t in x)
    codes = [np.array(sorted((10_000 * df[t] + t for t in x)), np.uint64).tobytes() for x in sets]
    texts = pairs._Texts(pa.table({"_n": [len(x) for x in sets], "_rep": list(range(len(sets))), "_side": [0] * len(sets), "_code": pa.array(codes, pa.binary())}))
    counted, shared = [], pairs._shared
    monkeypatch.setattr(pairs, "_shared", lambda p, q, a, b, needed: counted.append(len(a)) or shared(p, q, a, b, needed))
    for floor in (0.22, 0.3, 0.6):
        counted.clear()
        got = {frozenset((int(a), int(b))) for x, y, _ in pairs._links(texts, texts, 1, floor, True, False) for a, b in zip(x, y)}
        assert got == {frozenset((i, j)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if similarity(a, b) >= floor}
        assert len(got) >= 40 and sum(counted) < max(3 * len(got), len(sets) ** 2 / 20)


def test_greedy_matching_of_classes_equals_sequential(spark):
    rows = texts(random.Random(8), 160, copies=0.6)
    left, right = (spark.createDataFrame([x for x in rows if x[0] % 2 == k], "id long, tokens array<string>, s string") for k in (0, 1))
    got = {(x["a"], x["b"]) for x in pairs.greedy_class_matching(*pairs.overlap_links(left, right, 1, least_jaccard=0.5)).collect()}
    edges = [(-len(set(a) & set(b)), -x, i, j) for i, a, _ in rows for j, b, _ in rows if i % 2 == 0 and j % 2 and (x := similarity(a, b)) >= 0.5]
    want, used = set(), set()
    for _, _, i, j in sorted(edges):
        if not {i, j} & used:
            want.add((i, j))
            used |= {i, j}
    assert got == want and len(got) > 10


def test_large_group_of_copies_is_not_paired(spark):
    """Two thousand copies are one class and no link."""
    df = spark.range(2000).select("id", F.array(*[F.lit(x) for x in "abcd"]).alias("tokens"))
    members, links = pairs.overlap_links(df, df, 1, least_jaccard=0.6)
    assert members.count() == 2000 and members.select("rep").distinct().count() == 1 and links.isEmpty()


def test_folds_and_geometry(spark):
    assert models.select_geometry(50) is models.REDUCED and models.select_geometry(51) is models.PRIMARY and models.select_geometry(31) is None
    units = spark.range(0, 51).withColumnRenamed("id", "s")
    f = models.build_folds(units, "s", models.PRIMARY)
    got = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in f.groupBy("fold", "role").agg(F.min("s").alias("a"), F.max("s").alias("b")).collect()}
    want = {}
    for k, (train, first, last) in enumerate(models.fold_bounds(51, models.PRIMARY)):
        want |= {(k, "train"): (0, train - 1), (k, "embargo"): (train, first - 2), (k, "test"): (first - 1, last - 1)}
    assert got == want and all(r["is_safe"] for r in models.folds_are_safe(f, "s").collect())


def test_small_models():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = models.ridge(x, np.array([1.0, 3.0, 5.0, 7.0]), 1e-9)
    assert np.allclose(w, [1, 2], atol=1e-6)
    p = models.logistic(x - 1.5, np.array([0, 0, 1, 1.0]))
    assert p[1] > 0 and models.sigmoid(np.array([-1000.0]))[0] > 0


def test_bootstrap_of_one_cluster(spark):
    p = spark.createDataFrame([("m", 1, 2.0), ("m", 1, 4.0), ("n", 1, 1.0), ("n", 2, 3.0)], "spec string, s int, v double")
    got = {r["spec"]: r for r in models.cluster_bootstrap(p, "s", "v").collect()}
    assert got["m"]["estimate"] == 3.0 and got["m"]["low"] is None and got["n"]["low"] == 1.0


def test_tails():
    assert math.isclose(stats.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.f_upper(4.964602744, 1, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.binomial_two_sided(2, 10), 0.109375, rel_tol=1e-9)


def test_fixed_effects_match_dummies(spark):
    r = np.random.default_rng(3)
    rows = [(float(2 * (i % 2) + d + (i % 3) + r.normal()), float(i % 2), "abc"[i % 3], d, i % 5) for d in range(8) for i in range(30)]
    df = spark.createDataFrame(rows, "y double, x double, c string, d int, k int")
    got = stats.fixed_effects(df, "y", "x", "c", "d", "k").where("term = 'x'").first()
    design = np.array([[x, c == "b", c == "c", *(d == j for j in range(8))] for _, x, c, d, _ in rows], float)
    beta = np.linalg.lstsq(design, np.array([v[0] for v in rows]), rcond=None)[0]
    assert math.isclose(got["estimate"], beta[0], rel_tol=1e-8) and got["std_error"] > 0
