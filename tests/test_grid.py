"""The validation grid against a plain loop over specifications and folds."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import grid, models

SETS = {"none": [], "a": ["x"], "ab": ["x", "z"], "thin": ["w"]}
SENSITIVITIES = {"all": "true", "even": "session % 2 = 0", "none_left": "session < 0"}
GEOMETRY = models.Geometry("g", 30, 10, 1)


@pytest.fixture(scope="module")
def units():
    r = np.random.default_rng(4)
    t = pd.DataFrame({"session": range(80), "x": r.normal(size=80), "z": r.normal(size=80)})
    t["y"] = 0.5 * t["x"] - 0.2 * t["z"] + r.normal(size=80) * 0.3
    t["w"] = t["x"].where(t["session"] % 9 == 0)
    t.loc[[3, 50, 61], "x"] = None
    t.loc[[7, 55], "y"] = None
    return t


@pytest.fixture(scope="module")
def got(spark, units):
    df = spark.createDataFrame(units.astype(object).where(units.notna(), None).values.tolist(), "session long, x double, z double, y double, w double")
    specs = grid.expand(SETS, ["y"], list(SENSITIVITIES))
    out, predictions = grid.run_grid(df, models.build_folds(df, "session", GEOMETRY), specs, SENSITIVITIES, minimum=14, minimum_test=4)
    return {r["spec"]: r for r in out.collect()}, predictions.toPandas()


def plain(units, features, model, condition):
    """Predictions of the fittable folds, by the rule's own words."""
    rows = units[condition(units["session"])].dropna(subset=[*features, "y"])
    out = []
    for k, (last, first, end) in enumerate(models.fold_bounds(80, GEOMETRY)):
        train, test = rows[rows["session"] < last], rows[(rows["session"] >= first - 1) & (rows["session"] < end)]
        if len(train) < 14 or len(test) < 4:
            continue
        y = train["y"].to_numpy()
        if model == "mean":
            p = np.full(len(test), y.mean())
        elif model == "majority":
            p = np.full(len(test), float((y > 0).sum() * 2 >= len(y)))
        else:
            a, b = train[features].to_numpy(), test[features].to_numpy()
            m, s = a.mean(0), a.std(0)
            a, b = (a - m) / s, (b - m) / s
            a, b = np.c_[np.ones(len(a)), a], np.c_[np.ones(len(b)), b]
            if model == "ridge":
                w = np.linalg.solve(a.T @ a + np.diag([0.0] + [1.0] * len(features)), a.T @ y)
                p = b @ w
            else:
                w = np.zeros(a.shape[1])
                for _ in range(models.ITERATIONS):
                    g = a.T @ (1 / (1 + np.exp(-a @ w)) - (y > 0)) / len(a)
                    g[1:] += w[1:] / len(a)
                    w -= models.RATE * g
                p = 1 / (1 + np.exp(-b @ w))
        out += [(k, s, t, v) for s, t, v in zip(test["session"], test["y"], p)]
    return out


@pytest.mark.parametrize("name,condition", [("all", lambda s: s >= 0), ("even", lambda s: s % 2 == 0)])
@pytest.mark.parametrize("features,models_", [("none", ("mean", "majority")), ("a", ("ridge", "logistic")), ("ab", ("ridge", "logistic"))])
def test_predictions_and_measures(got, units, name, condition, features, models_):
    rows, predictions = got
    for model in models_:
        spec = f"{name}/y/{features}/{model}"
        want = plain(units, SETS[features], model, condition)
        mine = predictions[predictions["spec"] == spec].sort_values(["fold", "session"])
        assert list(zip(mine["fold"], mine["session"])) == [(k, s) for k, s, _, _ in want]
        assert np.allclose(mine["predicted"], [p for *_, p in want], atol=1e-9)
        r = rows[spec]
        assert r["status"] == grid.FITTED and r["requirement"] is None and r["n_predictions"] == len(want)
        actual, p = np.array([t for _, _, t, _ in want]), np.array([p for *_, p in want])
        if model in ("mean", "ridge"):
            assert r["mae"] == pytest.approx(np.abs(actual - p).mean()) and r["brier"] is None
            up = p > 0
        else:
            assert r["brier"] == pytest.approx(((p - (actual > 0)) ** 2).mean()) and r["mae"] is None
            up = p > 0.5
        assert r["accuracy"] == pytest.approx(((actual > 0) == up).mean())
        assert r["prediction_coverage"] == pytest.approx(len(want) / 50, abs=1e-4)


def test_refusals_name_what_binds(got):
    rows, _ = got
    thin, none = rows["all/y/thin/ridge"], rows["none_left/y/a/ridge"]
    assert (thin["status"], thin["requirement"], thin["n_predictions"]) == (grid.INSUFFICIENT, "9 usable rows < minimum_sessions_to_fit 14", 0)
    assert thin["missing"] == "w=71,y=2" and thin["rows_total"] == 80
    assert none["rows_total"] == 0 and none["requirement"] == "0 usable rows < minimum_sessions_to_fit 14" and none["coverage"] is None
    assert len(rows) == 3 * (2 + 2 + 2 + 2)


def test_without_folds_all_are_refused(spark):
    df = spark.range(20).selectExpr("id AS session", "double(id) AS x", "double(id) AS y")
    specs = grid.expand({"a": ["x"]}, ["y"], ["all"])
    folds = models.build_folds(df, "session", GEOMETRY)
    out, predictions = grid.run_grid(df, folds, specs, {"all": "true"}, minimum=14)
    assert {r["requirement"] for r in out.collect()} == {"no folds could be built from the available session range"} and predictions.count() == 0


def test_geometry_follows_the_sessions():
    assert [models.select_geometry(n) for n in (31, 32, 50, 51)] == [None, models.REDUCED, models.REDUCED, models.PRIMARY]
