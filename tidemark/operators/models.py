"""Walk-forward folds, small models, metrics, bootstrap and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.core import safe_corr


@dataclass(frozen=True)
class Geometry:
    """Sessions in the first training set, in a test set, and left out between them."""

    name: str
    train: int
    test: int
    embargo: int


#: Geometries by the number of sessions that they need, the largest first.
PRIMARY, REDUCED = Geometry("primary", 30, 10, 1), Geometry("reduced", 20, 6, 1)
NEEDED = ((51, PRIMARY), (32, REDUCED))
#: Draws and seed of the session bootstrap; iterations and rate of logistic descent; test rows that a fold needs.
DRAWS, SEED = 2000, 20260806
ITERATIONS, RATE, MIN_PREDICTIONS, MIN_SUBGROUP = 200, 0.1, 3, 8


def select_geometry(sessions: int) -> Geometry | None:
    return next((g for n, g in NEEDED if sessions >= n), None)


def fold_bounds(sessions: int, g: Geometry) -> list[tuple[int, int, int]]:
    """(train rows, first test row, last test row), 1-based, expanding; training ends ``embargo`` before the test."""
    out, start = [], g.train + 1
    while start + g.test - 1 <= sessions:
        out.append((start - 1 - g.embargo, start, start + g.test - 1))
        start += g.test
    return out


def build_folds(units: DataFrame, session: str, g: Geometry) -> DataFrame:
    """(fold, session, role): role is train, embargo or test.  Sessions are days, so their ranking is one small window."""
    ranked = units.select(session).distinct().withColumn("_i", F.row_number().over(W.orderBy(session)))
    n = F.count("*").over(W.partitionBy())
    # folds follow from the count of sessions alone: fold f tests rows train + 1 + f * test ...
    last = F.floor((F.col("_n") - g.train) / g.test)
    r = ranked.withColumn("_n", n).where(F.col("_n") >= g.train + g.test)
    f = r.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    first = F.lit(g.train + 1) + F.col("fold") * g.test
    role = F.when(F.col("_i") < first - g.embargo, "train").when(F.col("_i") < first, "embargo").when(F.col("_i") < first + g.test, "test")
    return f.withColumn("role", role).where("role IS NOT NULL").select("fold", session, "role")


def folds_are_safe(folds: DataFrame, session: str) -> DataFrame:
    """For each fold: sizes, and whether all training sessions precede all test sessions and none has two roles."""
    s = F.col(session)
    g = folds.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"), F.max(F.when(F.col("role") == "train", s)).alias("a"), F.min(F.when(F.col("role") == "test", s)).alias("b"), (F.count("*") == F.count_distinct(session)).alias("single")
    )
    return g.select("fold", "n_train", "n_test", (F.col("single") & (F.col("a") < F.col("b"))).alias("is_safe"))


def standardise(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By mean and population deviation of the training rows; deviations near zero count as one."""
    m, s = train.mean(axis=0), train.std(axis=0)
    s = np.where(s <= 1e-12, 1.0, s)
    return (train - m) / s, (test - m) / s


def ridge(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """Closed form; the intercept, first, is not penalised."""
    d = np.column_stack([np.ones(len(x)), x])
    p = strength * np.eye(d.shape[1])
    p[0, 0] = 0.0
    return np.linalg.solve(d.T @ d + p, d.T @ y)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, up: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """A fixed number of descent steps from zero, with l2 / n on all but the intercept."""
    d, n = np.column_stack([np.ones(len(x)), x]), len(x)
    w = np.zeros(d.shape[1])
    for _ in range(ITERATIONS):
        g = d.T @ (sigmoid(d @ w) - up) / n
        g[1:] += l2 / n * w[1:]
        w -= RATE * g
    return w


def predict_fold(train: pd.DataFrame, test: pd.DataFrame, features: Sequence[str], target: str, model: str, strength: float = 1.0) -> np.ndarray:
    """Predictions for the test rows: of the target, or of the chance that it is above zero (logistic, majority)."""
    y = train[target].to_numpy(float)
    if model == "mean":
        return np.full(len(test), y.mean())
    if model == "majority":
        signed = y[y != 0]
        return np.full(len(test), 1.0 if (signed > 0).sum() * 2 >= len(signed) else 0.0)
    a, b = standardise(train[list(features)].to_numpy(float), test[list(features)].to_numpy(float))
    if model == "ridge":
        w = ridge(a, y, strength)
        return w[0] + b @ w[1:]
    w = logistic(a, (y > 0).astype(float), strength)
    return sigmoid(w[0] + b @ w[1:])


def walk_forward(units: DataFrame, folds: DataFrame, session: str, target: str, specs: Sequence[tuple[str, Sequence[str], str]], strength: float = 1.0) -> DataFrame:
    """Predictions (spec, fold, session, actual, predicted) of each specification (name, features, model).

    Specifications times folds are the unit of parallelism; each is a small
    matrix.  Rows that lack a feature or the target are left out, and a fold with
    fewer complete training rows than features + 2 is refused.
    """
    wanted = sorted({f for _, fs, _ in specs for f in fs})
    rows = units.select(session, F.col(target).alias("_y"), *wanted).join(folds.where("role <> 'embargo'"), session)
    by_name = {n: (list(fs), m) for n, fs, m in specs}
    rows = rows.withColumn("spec", F.explode(F.array(*[F.lit(n) for n in by_name])))
    kind = units.schema[session].dataType.simpleString()

    def one(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        features, model = by_name[key[0]]
        batch = batch.dropna(subset=["_y", *features]).sort_values(session)
        train, test = batch[batch["role"] == "train"], batch[batch["role"] == "test"]
        if len(train) < len(features) + 2 or not len(test):
            return pd.DataFrame(columns=["spec", "fold", session, "actual", "predicted"])
        p = predict_fold(train, test, features, "_y", model, strength)
        return pd.DataFrame({"spec": key[0], "fold": key[1], session: test[session].to_numpy(), "actual": test["_y"].to_numpy(float), "predicted": p})

    return rows.groupBy("spec", "fold").applyInPandas(one, f"spec string, fold long, `{session}` {kind}, actual double, predicted double")


def regression_metrics(p: DataFrame, *by: str) -> DataFrame:
    """MAE, RMSE, correlation and R2 against the mean of the actual values."""
    e = F.col("actual") - F.col("predicted")
    out = p.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), safe_corr("actual", "predicted").alias("r"), F.var_pop("actual").alias("_v"), F.avg(e * e).alias("_m"))
    return out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("_m") / F.col("_v"))).drop("_v", "_m")


def direction_metrics(p: DataFrame, *by: str, boundary: float = 0.0) -> DataFrame:
    """Accuracy and balanced accuracy of the sign; zero outcomes are left out and a prediction is up only above the boundary."""
    up, said = F.col("actual") > 0, F.col("predicted") > boundary
    signed = p.where("actual <> 0")
    rate = lambda a, b: F.try_divide(F.count_if(a & b), F.nullif(F.count_if(a), F.lit(0)))
    out = signed.groupBy(*by).agg(F.count("*").alias("n"), F.avg((up == said).cast("double")).alias("accuracy"), rate(up, said).alias("up_recall"), rate(~up, ~said).alias("down_recall"))
    return out.withColumn("balanced_accuracy", (F.col("up_recall") + F.col("down_recall")) / 2)


def brier(p: DataFrame, *by: str) -> DataFrame:
    return p.groupBy(*by).agg(F.avg(F.pow(F.col("predicted") - (F.col("actual") > 0).cast("double"), 2)).alias("brier"))


def calibration(p: DataFrame, bins: int = 4) -> DataFrame:
    b = F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1))
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg((F.col("actual") > 0).cast("double")).alias("observed"))


#: Clusters of a block of the bootstrap, about, and draws that a task makes at once.
BLOCK_CLUSTERS, DRAWS_AT_ONCE = 20_000, 100


def resampled(sums: DataFrame, by: Sequence[str], cluster: str, values: Sequence[str], draws: int, seed: int, block: int = BLOCK_CLUSTERS) -> DataFrame:
    """by, draw (-1 for the clusters as they are) and the sums of ``values`` over each draw of clusters with replacement.

    Clusters are dealt into blocks.  How many picks of a draw fall to each block
    is multinomial by the blocks' sizes, and every task works that out from (seed,
    draw) alike; how often a block's own clusters are picked follows from (seed,
    draw, block).  Together that is a draw of all clusters, of which a task sees a
    block, and what it sends back has a row for each draw.
    """
    n = sums.groupBy(*by).agg(F.count("*").alias("_all"))
    number = F.pmod(F.xxhash64(F.col(cluster)), F.greatest(F.lit(1), F.ceil(F.col("_all") / block))).cast("int")
    left, right = sums.alias("s"), n.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by], F.lit(True))
    dealt = left.join(F.broadcast(right), on).select("s.*", number.alias("_block"))
    sizes = dealt.groupBy(*by, "_block").agg(F.count("*").alias("_size")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "_size"))).alias("_sizes"))
    left, right = dealt.alias("d"), sizes.alias("z")
    on = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"z.{c}")) for c in by], F.lit(True))
    rows = left.join(F.broadcast(right), on).select("d.*", "_sizes")

    def draw(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(cluster, kind="stable")
        mine, blocks = key[-1], [(int(z["_block"]), int(z["_size"])) for z in batch["_sizes"].iloc[0]]
        numbers, counts = [k for k, _ in blocks], np.array([c for _, c in blocks])
        at, all_ = numbers.index(mine), counts.sum()
        x = batch[list(values)].to_numpy(float)
        out = [(-1, *x.sum(axis=0))]
        for a in range(0, draws, DRAWS_AT_ONCE):
            for d in range(a, min(draws, a + DRAWS_AT_ONCE)):
                picks = np.random.default_rng([seed, d]).multinomial(all_, counts / all_)[at]
                chosen = np.random.default_rng([seed, d, mine + 1]).integers(0, len(x), picks)  # a last 0 would not count
                out.append((d, *(np.bincount(chosen, minlength=len(x)) @ x)))
        found = pd.DataFrame(out, columns=["draw", *values])
        for c, k in reversed(list(zip(by, key))):
            found.insert(0, c, k)
        return found

    names = "".join(f"`{c}` {sums.schema[c].dataType.simpleString()}, " for c in by)
    parts = rows.groupBy(*by, "_block").applyInPandas(draw, f"{names}draw long, " + ", ".join(f"{v} double" for v in values))
    return parts.groupBy(*by, "draw").agg(*[F.sum(v).alias(v) for v in values])


def _interval(draws: DataFrame, by: Sequence[str], estimate: Column) -> DataFrame:
    """by, estimate, low and high: the estimate of the clusters as they are, and the 2.5th and 97.5th percentiles of its draws."""
    e = draws.withColumn("_e", estimate)
    drawn = F.col("draw") >= 0
    share = lambda p: F.percentile(F.when(drawn, F.col("_e")), F.lit(p))
    return e.groupBy(*by).agg(F.max(F.when(~drawn, F.col("_e"))).alias("estimate"), share(0.025).alias("low"), share(0.975).alias("high"))


def cluster_bootstrap(p: DataFrame, cluster: str, value: str, by: Sequence[str] = ("spec",), draws: int = DRAWS, seed: int = SEED, block: int = BLOCK_CLUSTERS) -> DataFrame:
    """Mean of ``value`` with a 95 % interval from resampled clusters; one cluster gives no interval.

    Spark sums each cluster first; what is resampled is one pair of numbers a session.
    """
    sums = p.groupBy(*by, cluster).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).cast("double").alias("_n"))
    clusters = sums.groupBy(*by).agg(F.count("*").alias("clusters"))
    found = _interval(resampled(sums, by, cluster, ["_s", "_n"], draws, seed, block), by, F.try_divide("_s", F.greatest(F.col("_n"), F.when(F.col("draw") >= 0, 1.0).otherwise(0.0))))
    several = lambda c: F.when(F.col("clusters") > 1, F.col(c)).alias(c)
    return found.join(clusters, list(by)).select(*by, "estimate", several("low"), several("high"), "clusters")


def camp_gap_bootstrap(rows: DataFrame, camp, value: str, date: str, draws: int = 2000, seed: int = 20260707, block: int = BLOCK_CLUSTERS) -> DataFrame:
    """Interval of the difference of two camps' means by resampling dates; dates are summed first."""
    named = [(f(F.when(camp == c, F.col(value))), f"{n}{c}") for c in ("a", "b") for n, f in (("s", F.sum), ("n", F.count))]
    sums = rows.groupBy(date).agg(*[F.coalesce(x, F.lit(0)).cast("double").alias(n) for x, n in named])
    mean = lambda c: F.col(f"s{c}") / F.greatest(F.col(f"n{c}"), F.lit(1.0))
    found = _interval(resampled(sums, (), date, ["sa", "na", "sb", "nb"], draws, seed, block), (), mean("a") - mean("b"))
    return found.select(F.col("estimate").alias("gap"), "low", "high").crossJoin(F.broadcast(sums.agg(F.count("*").alias("dates"))))


def sample_gate(folds: DataFrame, complete: DataFrame, session: str, features: int, per_feature: int = 5) -> DataFrame:
    """Whether each fold has training rows for its features, and what is missing."""
    n = folds.where("role = 'train'").join(complete.select(session), session, "left_semi").groupBy("fold").agg(F.count("*").alias("n_train"))
    need = F.lit(features * per_feature)
    return n.withColumns({"allowed": F.col("n_train") >= need, "requirement": F.when(F.col("n_train") < need, F.concat(F.lit("needs "), need, F.lit(" sessions, has "), F.col("n_train")))})


def compare_to_baselines(p: DataFrame, baselines: Sequence[str], session: str) -> DataFrame:
    """For each other specification: its MAE, the best baseline's on the very same sessions, and a verdict."""
    base, rest = p.where(F.col("spec").isin(*baselines)), p.where(~F.col("spec").isin(*baselines))
    j = rest.alias("m").join(base.alias("b"), [session, "fold"]).groupBy(F.col("m.spec").alias("spec"), F.col("b.spec").alias("baseline")).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("m.actual") - F.col("m.predicted"))).alias("mae"), F.avg(F.abs(F.col("b.actual") - F.col("b.predicted"))).alias("baseline_mae")
    )
    best = j.where(F.col("n") >= MIN_PREDICTIONS).groupBy("spec").agg(F.min_by(F.struct("baseline", "n", "mae", "baseline_mae"), F.struct("baseline_mae", "baseline")).alias("x")).select("spec", "x.*")
    return best.withColumn("verdict", F.when(F.col("mae") < F.col("baseline_mae"), "beats_baseline").otherwise("no_improvement"))


def subgroups(p: DataFrame, by: str, least: int = MIN_SUBGROUP) -> DataFrame:
    return regression_metrics(p, "spec", by).withColumn("sufficient", F.col("n") >= least)
