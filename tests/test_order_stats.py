"""Ranks, quantiles and resampling against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, order_stats, stats


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # a hot group, ties, nulls, values that are not finite, a null group and one of a single row
    out = [(g, r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1), None])) for g in ["hot"] * 400 + ["b"] * 31 + [None] * 20]
    return [*out, ("one", 2.5), ("none", None), ("b", float("nan")), ("b", float("inf"))]


def test_quantiles(spark, rows):
    got = order_stats.grouped_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", {"a": 0.25, "m": 0.5, "z": 1.0, "o": 0.0})
    want = {}
    for g in ("hot", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None and np.isfinite(x)]
        want[g] = np.percentile(v, [25, 50, 100, 0])
    found = {r["g"]: (r["a"], r["m"], r["z"], r["o"]) for r in got.collect()}
    assert set(found) == set(want) and all(np.allclose(found[g], want[g]) for g in want)


def test_average_ranks(spark, rows):
    import pandas as pd

    t = pd.DataFrame([(g, v) for g, v in rows if v is not None and np.isfinite(v)], columns=["g", "v"])
    df = spark.createDataFrame(t.astype(object).where(t.notna(), None).values.tolist(), "g string, v double")
    whole = {r["v"]: r["rank"] for r in order_stats.average_ranks(df, "v").collect()}
    assert [whole[v] for v in t["v"]] == t["v"].rank().tolist()
    by = {(r["g"], r["v"]): r["rank"] for r in order_stats.average_ranks(df, "v", ["g"]).collect()}
    assert [by[g, v] for g, v in t.values] == t.groupby("g", dropna=False)["v"].rank().tolist()


def test_spearman(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 9, 60).astype(float)
    y = x + r.integers(0, 9, 60)
    got = stats.correlation(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double"), "a", "b", True).first()
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    assert got["n"] == 60 and got["r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_bootstrap_draws_all_clusters_whatever_the_blocks(spark):
    r = np.random.default_rng(1)
    data = [("m", c, float(v)) for c in range(40) for v in r.normal(c % 5, 1, 1 + c % 3)]
    df = spark.createDataFrame(data, "spec string, c int, v double")
    means = [np.mean([v for _, k, v in data if k == c]) for c in range(40)]
    sizes = [sum(k == c for _, k, _ in data) for c in range(40)]
    picks = np.random.default_rng(0).integers(0, 40, (4000, 40))
    s, n = np.array(means) * sizes, np.array(sizes)
    want = np.percentile(s[picks].sum(1) / n[picks].sum(1), [2.5, 97.5])
    for block in (7, 1000):
        got = models.cluster_bootstrap(df, "c", "v", draws=1500, block=block).first()
        assert got["estimate"] == pytest.approx(np.mean([v for *_, v in data])) and got["clusters"] == 40
        assert [got["low"], got["high"]] == pytest.approx(list(want), abs=0.08)
        again = models.cluster_bootstrap(df.repartition(5), "c", "v", draws=1500, block=block).first()
        assert tuple(again)[1:4] == pytest.approx(tuple(got)[1:4])
    sums = df.groupBy("spec", "c").agg(F.lit(1.0).alias("_s"), F.lit(1.0).alias("_n"))
    drawn = models.resampled(sums, ["spec"], "c", ["_s", "_n"], 20, 3, 7).collect()
    assert {x["_n"] for x in drawn} == {40.0} and len(drawn) == 21


def test_camp_gap(spark):
    data = [(d, "a" if i % 3 else "b", float(d % 4 + (i % 3 > 0))) for d in range(30) for i in range(6)]
    df = spark.createDataFrame(data, "d int, camp string, v double")
    r = models.camp_gap_bootstrap(df, F.col("camp"), "v", "d", draws=200, block=8).first()
    assert r["gap"] == pytest.approx(1.0) and r["low"] == pytest.approx(1.0, abs=0.5) and r["low"] <= r["gap"] <= r["high"] and r["dates"] == 30
