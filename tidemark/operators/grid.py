"""The validation grid: which specifications are fitted, which are refused and why, and what the fitted ones show.

A specification is a feature set, a model, a target and a sensitivity (a filter
on units).  All of them are gated before any is fitted, in one pass over the
units; a refusal is a row like any other, with the requirement that binds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.sources.shared import written

FITTED, INSUFFICIENT = "fitted", "insufficient_sample"
#: What the constant models stand for; a feature set without features is tried with these.
CONSTANT = ("mean", "majority")


@dataclass(frozen=True)
class Spec:
    feature_set: str
    features: tuple[str, ...]
    model: str
    target: str
    sensitivity: str

    @property
    def name(self) -> str:
        return f"{self.sensitivity}/{self.target}/{self.feature_set}/{self.model}"


def expand(feature_sets: Mapping[str, Sequence[str]], targets: Sequence[str], sensitivities: Sequence[str], models_for: Mapping[str, Sequence[str]] | None = None, default: Sequence[str] = ("ridge", "logistic")) -> list[Spec]:
    """Every specification.  The models of a set are fixed beforehand, so that none is tried until one of them works."""
    fixed = models_for or {}
    return [
        Spec(name, tuple(features), model, target, s)
        for s in sensitivities
        for target in targets
        for name, features in feature_sets.items()
        for model in fixed.get(name, default if features else CONSTANT)
    ]


def _complete(spec: Spec) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*spec.features, spec.target)])


def gates(units: DataFrame, folds: DataFrame, specs: Sequence[Spec], sensitivities: Mapping[str, str], session: str = "session", minimum: int = 30, minimum_test: int = 3) -> DataFrame:
    """sensitivity, target, feature_set, rows_total, rows_complete, coverage, missing (by column), fittable_folds, status, requirement.

    ``units`` has a row a session.  Each is looked at once and counted for every
    sample that it belongs to; what is joined with the folds are pairs of a session
    and a sample.  A fold is fittable with ``minimum`` complete training sessions
    and ``minimum_test`` complete test sessions.
    """
    samples = {(s.sensitivity, s.target, s.feature_set): s for s in specs}
    columns = sorted({c for s in samples.values() for c in (*s.features, s.target)})
    of = lambda s: F.struct(
        F.lit(s.sensitivity).alias("sensitivity"),
        F.lit(s.target).alias("target"),
        F.lit(s.feature_set).alias("feature_set"),
        _complete(s).alias("complete"),
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (*s.features, s.target)]).alias("missing"),
    )
    # what a sensitivity leaves out is no part of its samples
    listed = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(sensitivities[s.sensitivity]), F.lit(False)), of(s)) for s in samples.values()]))
    rows = written(units.select(session, *columns, F.explode(listed).alias("s")).select(session, "s.*"))
    by = ["sensitivity", "target", "feature_set"]
    totals = rows.groupBy(*by).agg(F.count("*").alias("rows_total"), F.count_if("complete").alias("rows_complete"))
    holes = rows.select(*by, F.explode(F.array_compact("missing")).alias("column")).groupBy(*by, "column").agg(F.count("*").alias("n"))
    holes = holes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "column", "n"))), ",").alias("missing"))
    role = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col(session)))
    fits = rows.where("complete").join(folds, session).groupBy(*by, "fold").agg(role("train").alias("n_train"), role("test").alias("n_test"))
    fits = fits.where((F.col("n_train") >= minimum) & (F.col("n_test") >= minimum_test)).groupBy(*by).agg(F.array_sort(F.collect_list("fold")).alias("fittable_folds"))
    have_folds = not folds.isEmpty()
    grid = units.sparkSession.createDataFrame(list(samples), "sensitivity string, target string, feature_set string")
    out = reduce(lambda a, b: a.join(b, by, "left"), [totals, holes, fits], grid).na.fill(0, ["rows_total", "rows_complete"])
    fittable = F.coalesce("fittable_folds", F.array().cast("array<long>"))
    binding = (
        F.when(F.col("rows_complete") < minimum, F.concat("rows_complete", F.lit(f" usable rows < minimum_sessions_to_fit {minimum}")))
        .when(F.lit(not have_folds), "no folds could be built from the available session range")
        .when(F.size(fittable) == 0, f"no fold has >= {minimum} training and >= {minimum_test} test sessions with complete features")
    )
    return out.select(
        *by, "rows_total", "rows_complete", F.round(F.try_divide("rows_complete", "rows_total"), 4).alias("coverage"), F.coalesce("missing", F.lit("")).alias("missing"),
        fittable.alias("fittable_folds"), F.when(binding.isNull(), FITTED).otherwise(INSUFFICIENT).alias("status"), binding.alias("requirement"),
    )


def run_grid(units: DataFrame, folds: DataFrame, specs: Sequence[Spec], sensitivities: Mapping[str, str], session: str = "session", minimum: int = 30, minimum_test: int = 3, strength: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(a row for each specification with its gate and pooled measures; the predictions).

    Only fittable folds of what passed its gate are fitted: the small table of
    gates goes to the driver, which plans the rest; specifications and folds are
    the unit of parallelism.  A specification without a prediction is refused
    after all.
    """
    gate = written(gates(units, folds, specs, sensitivities, session, minimum, minimum_test))
    passed = {(r["sensitivity"], r["target"], r["feature_set"]): r["fittable_folds"] for r in gate.where(F.col("status") == FITTED).collect()}
    parts = []
    for name, condition in sensitivities.items():
        for target in dict.fromkeys(s.target for s in specs):
            mine = [s for s in specs if s.sensitivity == name and s.target == target and (name, target, s.feature_set) in passed]
            if mine:
                p = models.walk_forward(units.where(condition), folds, session, target, [(s.name, s.features, s.model) for s in mine], strength)
                parts.append(p)
    spark = units.sparkSession
    table = spark.createDataFrame([(s.name, s.sensitivity, s.target, s.feature_set, s.model) for s in specs], "spec string, sensitivity string, target string, feature_set string, model string")
    kind = units.schema[session].dataType.simpleString()
    predictions = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"spec string, fold long, `{session}` {kind}, actual double, predicted double")
    named = predictions.join(F.broadcast(table), "spec").join(F.broadcast(gate.select("sensitivity", "target", "feature_set", "fittable_folds")), ["sensitivity", "target", "feature_set"])
    predictions = written(named.where(F.array_contains("fittable_folds", F.col("fold"))).select("spec", "model", "fold", session, "actual", "predicted"))
    # what a classifier says is a chance: up from a half on
    chance = F.col("model").isin("logistic", "majority")
    signed = predictions.withColumn("predicted", F.when(chance, F.col("predicted") - 0.5).otherwise(F.col("predicted")))
    measured = models.regression_metrics(signed.where(~chance), "spec").select("spec", "mae", "rmse", "r2")
    direction = models.direction_metrics(signed, "spec").select("spec", "accuracy", "balanced_accuracy")
    brier = models.brier(predictions.where(chance), "spec")
    testable = folds.where("role = 'test'").select(F.count_distinct(session).alias("testable"))
    counts = predictions.groupBy("spec").agg(F.count("*").alias("n_predictions"), F.count_distinct("fold").alias("n_folds"))
    stable = models.direction_metrics(signed, "spec", "fold").groupBy("spec").agg(F.min("accuracy").alias("accuracy_min"), F.max("accuracy").alias("accuracy_max"), F.count_if(F.col("accuracy") > 0.5).alias("folds_above_half"))
    out = table.join(gate, ["sensitivity", "target", "feature_set"]).join(F.broadcast(testable))
    out = reduce(lambda a, b: a.join(b, "spec", "left"), [counts, measured, direction, brier, stable], out).na.fill(0, ["n_predictions", "n_folds"])
    none = (F.col("status") == FITTED) & (F.col("n_predictions") == 0)
    out = out.withColumns(
        {
            "requirement": F.when(none, "no fold produced out-of-sample predictions").otherwise(F.col("requirement")),
            "status": F.when(none, INSUFFICIENT).otherwise(F.col("status")),
            "prediction_coverage": F.round(F.try_divide("n_predictions", F.nullif("testable", F.lit(0))), 4),
        }
    )
    return out.drop("testable"), predictions
