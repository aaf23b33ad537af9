"""Model fits as table jobs on ``pyspark.ml``."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import fresh_folder, remove, settle
from tablemill.skew import quantiles

REFIT_FOLD = -1
DISCRETE_VALUES = 10


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def _predictions(scored: DataFrame, keys: Sequence[str], name: str, fold: int, outcome: str, classify: bool) -> DataFrame:
    value = vector_to_array("probability")[1] if classify else F.col("prediction")
    return scored.select(
        *keys, F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.lit(outcome).alias("task"),
        F.col(outcome).cast("double").alias("actual"), value.alias("predicted"), F.col("prediction").alias("label"),
    )


def plain(model: Model, spark: SparkSession) -> Model:
    """The model as saved and loaded again: without its training summary, which holds on to the session."""
    path = fresh_folder(spark, "model")
    model.write().save(path)
    try:
        return type(model).load(path)
    finally:
        remove(spark, path)


def cv_train(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    outcomes: Sequence[str],
    estimators: Mapping[str, Callable[[], Estimator]],
    fold: str,
    folds: int,
    classify: bool = True,
    weight: str | None = None,
    refit: bool = False,
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> tuple[DataFrame, dict[tuple[str, int, str], Model]]:
    """Fit every (estimator, fold, outcome); out-of-fold predictions as rows, and the models.

    ``prepare`` may transform each fold's training and test tables. With ``refit`` every
    estimator is also fitted on all rows (fold -1).
    """
    models: dict[tuple[str, int, str], Model] = {}
    parts = []
    plan = [(i, df.where(F.col(fold) != i), df.where(F.col(fold) == i)) for i in range(folds)]
    if refit:
        plan.append((REFIT_FOLD, df, df.limit(0)))
    for i, train, test in plan:
        if prepare is not None:
            train, test = prepare(train, test)
        train, test = assemble(train, features).persist(), assemble(test, features)
        for outcome in outcomes:
            for name, make in estimators.items():
                estimator = make().setFeaturesCol("features").setLabelCol(outcome)
                if weight is not None:
                    estimator = estimator.setWeightCol(weight)
                model = plain(estimator.fit(train), df.sparkSession)
                models[name, i, outcome] = model
                if i != REFIT_FOLD:
                    parts.append(_predictions(model.transform(test), keys, name, i, outcome, classify))
        train.unpersist()
    return functools.reduce(lambda a, b: a.unionByName(b), parts), models


def predict_refit(
    models: Mapping[tuple[str, int, str], Model], df: DataFrame, keys: Sequence[str], features: Sequence[str], trained_on: Sequence[str], classify: bool = True
) -> DataFrame:
    """Score new rows with the models fitted on everything; the feature lists must match."""
    if list(features) != list(trained_on):
        raise ValueError(f"features differ from training: {sorted(set(features) ^ set(trained_on))}")
    rows = assemble(df, features)
    parts = []
    for (name, fold, outcome), model in models.items():
        if fold == REFIT_FOLD:
            source = rows if outcome in rows.columns else rows.withColumn(outcome, F.lit(None).cast("double"))
            parts.append(_predictions(model.transform(source), keys, name, fold, outcome, classify))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def importance_table(models: Mapping[tuple[str, int, str], Model], features: Sequence[str], spark) -> DataFrame:
    """(model, fold, task, feature, value): tree importances or linear coefficients.

    Models with neither are skipped; a length that does not match the features is an error.
    """
    rows = []
    for (name, fold, outcome), model in models.items():
        values = getattr(model, "featureImportances", None)
        values = values if values is not None else getattr(model, "coefficients", None)
        if values is None:
            continue
        numbers = np.asarray(values.toArray(), dtype=float)
        if len(numbers) != len(features):
            raise ValueError(f"{name}: {len(numbers)} importances for {len(features)} features")
        rows += [(name, fold, outcome, f, float(v)) for f, v in zip(features, numbers)]
    return spark.createDataFrame(rows, "model string, fold int, task string, feature string, value double")


def grid_parameters(models: Mapping[tuple[str, int, str], Model], names: Sequence[str], spark) -> DataFrame:
    """(model, fold, variable, value): best parameters of every parameter search."""
    rows = []
    for (name, fold, _), model in models.items():
        if isinstance(model, CrossValidatorModel) or hasattr(model, "bestModel"):
            best = model.bestModel
            rows += [(name, fold, p.name, str(v)) for p, v in best.extractParamMap().items() if p.name in names]
    return spark.createDataFrame(rows, "model string, fold int, variable string, value string")


def dependence_grid(df: DataFrame, feature: str, size: int = 100, window: tuple[float, float] = (0.0, 1.0)) -> list[float]:
    """Distinct values when there are at most ten, else equal steps between two quantiles."""
    few = df.select(F.col(feature).cast("double").alias("v")).distinct().limit(DISCRETE_VALUES + 1).collect()
    if len(few) <= DISCRETE_VALUES:
        return sorted(r["v"] for r in few if r["v"] is not None)
    ends = quantiles(df, [], feature, {"lo": window[0], "hi": window[1]}).first()
    return [float(x) for x in np.linspace(ends["lo"], ends["hi"], size)]


def dependence_curves(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, keys: Sequence[str], feature: str, grid: Sequence[float]
) -> DataFrame:
    """(keys, grid, prediction): every row predicted with the feature set to each grid value."""
    spread = df.withColumn("grid", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn(feature, F.col("grid"))
    return predict(spread).select(*keys, "grid", "prediction")


def partial_dependence(curves: DataFrame) -> DataFrame:
    return curves.groupBy("grid").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))


def univariate_dependence(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], feature: str, grid: Sequence[float], others: str | Mapping[str, float] = "mean"
) -> DataFrame:
    """(grid, prediction) with the other features at their mean, zero or given values."""
    if others == "mean":
        base = df.agg(*[F.avg(f).alias(f) for f in features])
    else:
        values = {f: 0.0 for f in features} if others == "zero" else {f: float(others[f]) for f in features}
        base = df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{f}` double" for f in values))
    return dependence_curves(predict, base, [], feature, grid)


def predictor(model: Transformer, features: Sequence[str], classify: bool) -> Callable[[DataFrame], DataFrame]:
    """Function that adds a numeric ``prediction`` (class 1 probability for classifiers)."""
    def run(df: DataFrame) -> DataFrame:
        scored = model.transform(assemble(df, features))
        return scored.withColumn("prediction", vector_to_array("probability")[1]) if classify else scored

    return run


def ice_clusters(curves: DataFrame, rows: DataFrame, key: str, grid: Sequence[float], others: Sequence[str], clusters: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cluster the per-row curves, then ask which other features tell the clusters apart.

    Returns (key, cluster) and (feature, value).
    """
    spark = curves.sparkSession
    spots = [F.max(F.when(F.col("grid") == float(g), F.col("prediction"))).alias(f"_g{i}") for i, g in enumerate(grid)]
    wide = settle(assemble(curves.groupBy(key).agg(*spots), [f"_g{i}" for i in range(len(grid))]).select(key, "features"), "curves")
    groups = KMeans(k=clusters, seed=seed, predictionCol="cluster").fit(wide).transform(wide).select(key, "cluster")
    labelled = assemble(rows.join(groups, key), others)
    forest = RandomForestClassifier(labelCol="cluster", featuresCol="features", numTrees=20, seed=seed).fit(labelled)
    values = [(f, float(v)) for f, v in zip(others, forest.featureImportances.toArray())]
    return groups, spark.createDataFrame(values, "feature string, value double")


def boosting_losses(model, train: DataFrame, test: DataFrame, features: Sequence[str], loss: str = "squared") -> DataFrame:
    """(trees, train, test): loss of a boosted model after each number of trees."""
    a = model.evaluateEachIteration(assemble(train, features), loss)
    b = model.evaluateEachIteration(assemble(test, features), loss)
    return train.sparkSession.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "trees int, train double, test double")


def entity_linear_fits(df: DataFrame, entity: str, features: Sequence[str], outcome: str) -> DataFrame:
    """(entity, n, coefficients): least squares per entity from sums of products.

    Only the sums travel, one row per entity, so an entity may have any number of rows.
    """
    names = ["_one", *features]
    x = {n: F.lit(1.0) if n == "_one" else F.col(f"`{n}`").cast("double") for n in names}
    y = F.col(outcome).cast("double")
    size = len(names)
    products = [F.sum(x[a] * x[b]).alias(f"_xx_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    targets = [F.sum(x[a] * y).alias(f"_xy_{i}") for i, a in enumerate(names)]
    sums = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *products, *targets)
    matrix = F.array(*[F.col(f"_xx_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    vector = F.array(*[F.col(f"_xy_{i}") for i in range(size)])

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.asarray(a, float).reshape(size, size), np.asarray(b, float), rcond=None)[0].tolist() for a, b in zip(m, v)])

    return sums.select(entity, "n", solve(matrix, vector).alias("coefficients"))


def entity_blend(
    overall: DataFrame, fits: DataFrame, entity: str, features: Sequence[str], weight: float = 0.75, min_rows: int = 25
) -> DataFrame:
    """Mix the overall ``prediction`` with the entity's own fit when it has more than min_rows rows."""
    joined = overall.join(fits, entity, "left")
    own = F.col("coefficients")[0]
    for i, f in enumerate(features):
        own = own + F.col("coefficients")[i + 1] * F.col(f"`{f}`")
    share = F.when(F.col("n") > min_rows, weight).otherwise(0.0)
    blended = F.when(F.col("coefficients").isNull() | (share == 0), F.col("prediction")).otherwise((1 - share) * F.col("prediction") + share * own)
    return joined.withColumn("blended", blended).drop("coefficients", "n")


def multi_output_fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], outcomes: Sequence[str], make: Callable[[], Estimator]) -> tuple[DataFrame, dict[str, Model]]:
    """One model per outcome, predictions side by side."""
    rows = settle(assemble(df, features), "rows")
    models = {o: make().setFeaturesCol("features").setLabelCol(o).setPredictionCol(f"{o}_prediction").fit(rows) for o in outcomes}
    out = rows
    for model in models.values():
        out = model.transform(out)
    return out.select(*keys, *[f"{o}_prediction" for o in outcomes]), models
