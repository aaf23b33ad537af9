"""Cross-validated least squares from sums of products.

One pass adds up a matrix of products per fold. The sums of a training set are the total
less those of its test fold, so all folds, outcomes and ridge parameters cost that one pass,
and what reaches the driver has as many numbers as the matrices. Predictions are column
expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.modeling.training import REFIT_FOLD

#: Rows whose means the columns are shifted by, for precision alone.
SHIFT_ROWS = 1000


@dataclass(frozen=True)
class FoldSums:
    """Sums of products of (1, features, outcomes), shifted, per fold."""

    features: tuple[str, ...]
    outcomes: tuple[str, ...]
    shift: np.ndarray
    sums: Mapping[int, np.ndarray]

    def without(self, *folds: int) -> np.ndarray:
        return sum((m for k, m in self.sums.items() if k not in folds), np.zeros((len(self.shift) + 1,) * 2))


@dataclass(frozen=True)
class Linear:
    intercept: float
    slopes: tuple[float, ...]
    ridge: float = 0.0


def fold_sums(df: DataFrame, features: Sequence[str], outcomes: Sequence[str], fold: str, weight: str | None = None) -> FoldSums:
    """Rows with a missing feature, outcome, weight or fold are left out."""
    names = [*features, *outcomes]
    number = lambda c: F.col(f"`{c}`").cast("double")
    used = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)], F.col(fold).cast("int").alias("fold"), (number(weight) if weight else F.lit(1.0)).alias("w")).dropna()
    few = used.limit(SHIFT_ROWS).agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()
    shift = np.array([v or 0.0 for v in few])
    x = [F.lit(1.0), *[F.col(f"x{i}") - F.lit(float(s)) for i, s in enumerate(shift)]]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    rows = used.groupBy("fold").agg(*[F.sum(F.col("w") * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in cells]).collect()  # one row a fold
    sums = {}
    for r in rows:
        m = np.zeros((len(x), len(x)))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        sums[r["fold"]] = m
    return FoldSums(tuple(features), tuple(outcomes), shift, sums)


def solve(held: FoldSums, outcome: str, leave: Sequence[int] = (), ridge: float = 0.0) -> Linear:
    """Least squares on all folds but those left out; ``ridge`` times the rows is added to the squared slopes' cost."""
    m = held.without(*leave)
    n, p = m[0, 0], len(held.features)
    at = 1 + p + held.outcomes.index(outcome)
    if n <= 0:
        raise ValueError("no rows to train on")
    mean = m[0] / n
    cov = m[1 : p + 1, 1 : p + 1] - n * np.outer(mean[1 : p + 1], mean[1 : p + 1]) + ridge * n * np.eye(p)
    target = m[1 : p + 1, at] - n * mean[1 : p + 1] * mean[at]
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    size[size == 0] = 1.0
    slopes = np.linalg.lstsq(cov / np.outer(size, size), target / size, rcond=1e-12)[0] / size
    intercept = mean[at] + held.shift[at - 1] - slopes @ (mean[1 : p + 1] + held.shift[:p])
    return Linear(float(intercept), tuple(float(b) for b in slopes), ridge)


def squared_error(held: FoldSums, fit: Linear, outcome: str, fold: int) -> float:
    """Sum of squared errors of a fit on one fold, from its sums alone."""
    p = len(held.features)
    at = 1 + p + held.outcomes.index(outcome)
    row = np.zeros(len(held.shift) + 1)
    row[0] = fit.intercept + np.dot(fit.slopes, held.shift[:p]) - held.shift[at - 1]
    row[1 : p + 1], row[at] = fit.slopes, -1.0
    return float(row @ held.sums[fold] @ row)


def predicted(features: Sequence[str], fit: Linear) -> Column:
    out = F.lit(fit.intercept)
    for c, b in zip(features, fit.slopes):
        out = out + F.lit(b) * F.col(f"`{c}`")
    return out


def _rows(df: DataFrame, keys: Sequence[str], value: Column, name: str, fold: Column, outcome: str) -> DataFrame:
    actual = F.col(outcome).cast("double") if outcome in df.columns else F.lit(None).cast("double")
    return df.select(*keys, F.lit(name).alias("model"), fold.cast("int").alias("fold"), F.lit(outcome).alias("task"), actual.alias("actual"), value.alias("predicted"))


def cv_least_squares(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], outcomes: Sequence[str], fold: str, folds: int, weight: str | None = None,
    name: str = "linear", refit: bool = False, ridges: Sequence[float] = (0.0,),
) -> tuple[DataFrame, dict[tuple[str, int, str], Linear]]:
    """Out-of-fold predictions (keys, model, fold, task, actual, predicted) and all fits.

    Of several ``ridges`` every training set takes the one with the least squared error when
    each of its folds is predicted from its other folds; the smallest wins ties. With
    ``refit`` there is also a fit on all rows (fold -1).
    """
    held = fold_sums(df, features, outcomes, fold, weight)
    fits: dict[tuple[str, int, str], Linear] = {}
    parts = []
    for outcome in outcomes:
        for i in [*range(folds), *([REFIT_FOLD] if refit else [])]:
            inner = [j for j in held.sums if j != i]
            cost = {r: sum(squared_error(held, solve(held, outcome, (i, j), r), outcome, j) for j in inner) for r in ridges} if len(ridges) > 1 and len(inner) > 1 else {ridges[0]: 0.0}
            fits[name, i, outcome] = solve(held, outcome, (i,), min(cost, key=lambda r: (cost[r], r)))
        choose = F.lit(None).cast("double")
        for i in range(folds):
            choose = F.when(F.col(fold) == i, predicted(features, fits[name, i, outcome])).otherwise(choose)
        parts.append(_rows(df, keys, choose, name, F.col(fold), outcome).where(F.col("fold").between(0, folds - 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fits


def predict_linear(fits: Mapping[tuple[str, int, str], Linear], df: DataFrame, keys: Sequence[str], features: Sequence[str], trained_on: Sequence[str]) -> DataFrame:
    """Score new rows with the fits on all rows; the feature lists must match."""
    if list(features) != list(trained_on):
        raise ValueError(f"features differ from training: {sorted(set(features) ^ set(trained_on))}")
    parts = [_rows(df, keys, predicted(features, fit), name, F.lit(i), outcome) for (name, i, outcome), fit in fits.items() if i == REFIT_FOLD]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coefficient_table(fits: Mapping[tuple[str, int, str], Linear], features: Sequence[str], spark) -> DataFrame:
    """(model, fold, task, feature, value): the slopes of every fit."""
    rows = [(name, i, outcome, f, b) for (name, i, outcome), fit in fits.items() for f, b in zip(features, fit.slopes)]
    return spark.createDataFrame(rows, "model string, fold int, task string, feature string, value double")


def ridge_table(fits: Mapping[tuple[str, int, str], Linear], spark) -> DataFrame:
    """(model, fold, variable, value): the ridge parameter every fit chose."""
    rows = [(name, i, "ridge", repr(float(fit.ridge))) for (name, i, _), fit in fits.items()]
    return spark.createDataFrame(rows, "model string, fold int, variable string, value string")


def multi_output_linear(df: DataFrame, keys: Sequence[str], features: Sequence[str], outcomes: Sequence[str]) -> tuple[DataFrame, dict[str, Linear]]:
    """One fit per outcome from the same sums, predictions side by side."""
    held = fold_sums(df.withColumn("_all", F.lit(0)), features, outcomes, "_all")
    fits = {o: solve(held, o) for o in outcomes}
    return df.select(*keys, *[predicted(features, fit).alias(f"{o}_prediction") for o, fit in fits.items()]), fits
