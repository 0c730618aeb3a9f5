"""Statistics of reports: effect sizes, tests, intervals and regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.core import safe_corr
from tidemark.operators.order_stats import average_ranks, grouped_quantiles


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Sum of the chances of all outcomes no more likely than k."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    at = log(k)
    return min(1.0, sum(math.exp(log(i)) for i in range(n + 1) if log(i) <= at + 1e-9))


def correlation(rows: DataFrame, a: str, b: str, spearman: bool = False) -> DataFrame:
    """n, r and two-sided p over rows where both are known; Spearman's r is that of average ranks."""
    t = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    if spearman:
        for c in (a, b):
            t = t.join(average_ranks(t, c, name="_rank"), c).drop(c).withColumnRenamed("_rank", c)
    out = t.agg(F.count("*").alias("n"), safe_corr(a, b).alias("r"))

    @F.pandas_udf("double")
    def p(n: pd.Series, r: pd.Series) -> pd.Series:
        one = lambda n_, r_: None if n_ < 3 or r_ != r_ else 0.0 if abs(r_) >= 1 else t_two_sided(r_ * math.sqrt((n_ - 2) / (1 - r_ * r_)), n_ - 2)
        return pd.Series([one(x, y) for x, y in zip(n, r)], dtype="float64")

    return out.withColumn("p_value", p("n", "r"))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", key: str = "test") -> DataFrame:
    """q values: the least of p * m / rank from this rank on."""
    ranked = tests.withColumns({"_rank": F.row_number().over(W.orderBy(p, key)), "_m": F.count("*").over(W.partitionBy())})
    q = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(W.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("q_value", F.least(q, F.lit(1.0))).drop("_rank", "_m")


def mean_difference(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """Means, sizes, difference, pooled-deviation effect size and Welch's t of the groups "a" and "b"."""
    x = F.col(value)
    agg = rows.agg(*[f(F.when(group == g, x)).alias(f"{n}_{g}") for g in ("a", "b") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / (na + nb - 2)
    diff = F.col("mean_a") - F.col("mean_b")
    return agg.withColumns({"difference": diff, "cohens_d": F.when(pooled > 0, diff / F.sqrt(pooled)), "welch_t": diff / F.sqrt(F.col("var_a") / na + F.col("var_b") / nb)})


def distribution(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each column: n, mean, sample deviation, quartiles and sign shares."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variant"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    quartiles = grouped_quantiles(long, ["variant"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    share = lambda c: F.avg(F.when(F.col("v").isNotNull(), c.cast("double")))
    out = long.groupBy("variant").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        share(F.col("v") > 0).alias("positive_share"), share(F.col("v") < 0).alias("negative_share"), share(F.col("v") == 0).alias("zero_share"),
    )
    return out.join(quartiles, "variant", "left")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r of all pairs of columns in one pass; each pair over the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = rows.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), safe_corr(a, b).alias("r")).alias(f"{a}_{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*wide.columns)).alias("x")).select("x.*")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How often two signals point the same way: zeros counted as a direction, and without them."""
    sa, sb = F.signum(a), F.signum(b)
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    nonzero = known & (sa != 0) & (sb != 0)
    return rows.agg(
        F.count_if(known).alias("n"), F.avg(F.when(known, (sa == sb).cast("double"))).alias("agreement"), F.count_if(nonzero).alias("n_nonzero"), F.avg(F.when(nonzero, (sa == sb).cast("double"))).alias("agreement_nonzero")
    )


def predictive(rows: DataFrame, signal: str, target: str) -> DataFrame:
    """Correlation with the target, hits among rows where both have a direction, and zero counts."""
    known = F.col(signal).isNotNull() & F.col(target).isNotNull()
    s, t = F.when(known, F.col(signal)), F.when(known, F.col(target))
    signed = known & (s != 0) & (t != 0)
    hit = F.count_if(signed & (F.signum(s) == F.signum(t)))
    return rows.agg(F.count_if(known).alias("n"), safe_corr(s, t).alias("r"), F.count_if(signed).alias("n_signed"), hit.alias("hits"), F.try_divide(hit, F.nullif(F.count_if(signed), F.lit(0))).alias("hit_rate"), F.count_if(s == 0).alias("zero_signals"), F.count_if(t == 0).alias("zero_targets"))


def beta_adjusted(rows: DataFrame, y: str, x: str, least: int = 10) -> DataFrame:
    """Slope of y on x (1 below ``least`` pairs) and each row's abnormal part."""
    fit = rows.agg(F.when(F.regr_count(y, x) >= least, F.regr_slope(y, x)).otherwise(1.0).alias("beta"))
    return rows.crossJoin(F.broadcast(fit)).withColumn("abnormal", F.col(y) - F.col("beta") * F.col(x))


def detectable_r(n: Column) -> Column:
    """The least |r| found with 80 % power at 5 %."""
    return F.when(n > 3, F.tanh((F.lit(1.959963984540054) + F.lit(0.8416212335729143)) / F.sqrt(n - 3)))


def granger(series: DataFrame, y: str, x: str, lags: int, order: str = "date") -> DataFrame:
    """F test of lags of x in a regression of y on its own lags: nested least squares from one row of sums.

    All products that the normal equations need are summed by Spark; the driver
    solves matrices of 1 + 2 * lags columns.
    """
    w = W.orderBy(order)
    cols = [F.lag(c, k).over(w).alias(f"{c}_{k}") for c in (y, x) for k in range(1, lags + 1)]
    t = series.select(F.col(y).alias("y0"), *cols).dropna()
    names = ["one", *[f"{y}_{k}" for k in range(1, lags + 1)], *[f"{x}_{k}" for k in range(1, lags + 1)], "y0"]
    t = t.withColumn("one", F.lit(1.0))
    sums = t.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]).first()
    k = len(names)
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)

    def rss(use):
        b = np.linalg.lstsq(m[np.ix_(use, use)], m[use, -1], rcond=None)[0]
        return m[-1, -1] - b @ m[use, -1]

    n, full, part = int(round(m[0, 0])), list(range(k - 1)), list(range(lags + 1))
    df2 = n - len(full)
    if df2 <= 0:
        return series.sparkSession.createDataFrame([(lags, n, None, None)], "lags int, n int, f double, p_value double")
    a, b = rss(part), rss(full)
    f = ((a - b) / lags) / (b / df2) if b > 0 else float("inf")
    return series.sparkSession.createDataFrame([(lags, n, float(f), float(f_upper(f, lags, df2)))], "lags int, n int, f double, p_value double")


def fixed_effects(rows: DataFrame, y: str, x: str, dummies: str, absorb: str, cluster: str) -> DataFrame:
    """OLS of y on x and category dummies with one absorbed effect; deviations clustered.

    Demeaning within the absorbed key leaves few columns; Spark sums their
    products once for the normal equations and once, by cluster, for the scores.
    """
    levels = [r[0] for r in rows.select(dummies).distinct().orderBy(dummies).limit(51).collect()][1:]
    if len(levels) >= 50:
        raise ValueError(f"{dummies} has too many levels for explicit columns")
    base = rows.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x0"), F.col(absorb).alias("_a"), F.col(cluster).alias("_c"), *[(F.col(dummies) == v).cast("double").alias(f"x{i + 1}") for i, v in enumerate(levels)]).dropna()
    names = ["x0", *[f"x{i + 1}" for i in range(len(levels))]]
    w = W.partitionBy("_a")
    dm = base.select("_c", "_a", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ["y", *names]])
    k = len(names)
    g = dm.agg(F.count("*").alias("n"), F.count_distinct("_a").alias("ga"), F.count_distinct("_c").alias("gc"), *[F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, "y"])]).first()
    gram = np.array([[g[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    xty = np.array([g[f"g{i}_{k}"] or 0.0 for i in range(k)])
    if np.linalg.matrix_rank(gram, tol=1e-9 * max(1.0, np.abs(gram).max())) < k:
        raise ValueError("the design has no full rank")
    inv = np.linalg.inv(gram)
    beta = inv @ xty
    resid = F.col("y") - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names)), F.lit(0.0))
    scores = dm.groupBy("_c").agg(*[F.sum(F.col(c) * resid).alias(c) for c in names])
    meat = scores.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).first()
    m = np.array([[meat[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    n, gc = g["n"], g["gc"]
    scale = gc / (gc - 1) * (n - 1) / (n - k - g["ga"]) if gc > 1 and n > k + g["ga"] else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv @ m @ inv) * scale, 0))
    out = [(c, float(b), float(s), float(b / s) if s > 0 else None, n, gc) for c, b, s in zip([x, *[f"{dummies}={v}" for v in levels]], beta, se)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, t double, n long, clusters long")
