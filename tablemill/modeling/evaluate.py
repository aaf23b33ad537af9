"""Evaluation tables: predictions and importances in long form."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import settle
from tablemill.skew import attach, bucketed, join_on_keys, quantiles, running, top_rows

EPSILON = 1e-15


def melt_predictions(wide: Mapping[str, DataFrame], keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Prediction tables by model to one (keys, model, actual, predicted) table."""
    parts = [
        df.select(*keys, F.lit(name).alias("model"), F.col(actual).cast("double").alias("actual"), F.col(predicted).cast("double").alias("predicted"))
        for name, df in wide.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def scores(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column], pooled: bool = False) -> DataFrame:
    """Long (keys, metric, value) of aggregate expressions per model and fold, or pooled (fold 'All')."""
    rows = df.withColumn("fold", F.lit("All")) if pooled else df.withColumn("fold", F.col("fold").cast("string"))
    wide = rows.groupBy(*keys).agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    return wide.unpivot(list(keys), [F.col(f"`{m}`") for m in metrics], "metric", "value")


def regression_metrics(actual: str = "actual", predicted: str = "predicted", names: Sequence[str] = ("mse", "rmse", "mae", "rsquared")) -> dict[str, Column]:
    """mse, rmse, mae and rsquared (squared correlation); an unknown name is an error."""
    a, p = F.col(actual), F.col(predicted)
    mse = F.avg((a - p) * (a - p))
    known = {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(a - p)), "rsquared": F.corr(a, p) ** 2}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"score not valid: {unknown}")
    return {n: known[n] for n in names}


def clipped(p: Column, epsilon: float = EPSILON) -> Column:
    return F.when(p < epsilon, F.lit(epsilon)).when(p > 1 - epsilon, F.lit(1 - epsilon)).otherwise(p)


def log_loss(actual: Column, probability: Column) -> Column:
    p = clipped(probability)
    return -F.avg(actual * F.log(p) + (1 - actual) * F.log(1 - p))


def threshold_curve(df: DataFrame, keys: Sequence[str], actual: str = "actual", score: str = "predicted") -> DataFrame:
    """Per distinct threshold, highest first: tp, fp so far, and the totals.

    Rows are counted per score before the running sums, so ties cost nothing.
    """
    hit = F.col(actual) == 1
    counts = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.count(F.when(hit, 1)).alias("_p"), F.count(F.when(~hit, 1)).alias("_n"))
    ran = running(counts, keys, ["-threshold"], {"tp": ("sum", F.col("_p")), "fp": ("sum", F.col("_n"))})
    totals = counts.groupBy(*keys).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return join_on_keys(ran, totals, keys)


def roc_points(df: DataFrame, keys: Sequence[str], actual: str = "actual", score: str = "predicted") -> DataFrame:
    """(keys, threshold, x, y): false and true positive rate at every distinct score."""
    c = threshold_curve(df, keys, actual, score)
    return c.select(*keys, "threshold", F.try_divide("fp", "negatives").alias("x"), F.try_divide("tp", "positives").alias("y"))


def binary_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", score: str = "predicted", cut: float = 0.5) -> DataFrame:
    """accuracy, clipped log loss, exact ROC AUC and trapezoid PR AUC (from the first threshold on)."""
    a, p = F.col(actual).cast("double"), F.col(score)
    simple = df.groupBy(*keys).agg(
        F.avg(((p >= cut).cast("int") == a).cast("int")).alias("accuracy"), log_loss(a, p).alias("logloss")
    )
    c = threshold_curve(df, keys, actual, score)
    roc = (F.col("_n") * (F.col("tp") - F.col("_p") / 2)).cast("double")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double"))
    before_tp, before_all = F.col("tp") - F.col("_p"), F.col("tp") + F.col("fp") - F.col("_p") - F.col("_n")
    width = recall - F.try_divide(before_tp.cast("double"), F.col("positives").cast("double"))
    pr = F.when(before_all > 0, width * (precision + before_tp / before_all) / 2).otherwise(0.0)
    areas = c.groupBy(*keys).agg(
        F.try_divide(F.sum(roc), F.max(F.col("positives") * F.col("negatives")).cast("double")).alias("roc_auc"), F.sum(pr).alias("pr_auc")
    )
    return join_on_keys(simple, areas, keys)


def multiclass_log_loss(actual: Column, probabilities: Column) -> Column:
    """-mean log of the true class's probability; classes are numbered from 0."""
    return -F.avg(F.log(clipped(F.element_at(probabilities, actual.cast("int") + 1))))


def confusion(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "label") -> DataFrame:
    """(keys, actual, predicted, n, percent, kind) with TP/FP/TN/FN for 0/1 labels."""
    a, p = F.col("actual"), F.col("predicted")
    counts = df.groupBy(*keys, F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when((a == 1) & (p == 1), "TP").when((a == 0) & (p == 1), "FP").when((a == 0) & (p == 0), "TN").when((a == 1) & (p == 0), "FN")
    return attach(counts, keys, {"_all": F.sum("n")}).withColumns({"percent": 100 * F.col("n") / F.col("_all"), "kind": kind}).drop("_all")


def agreement(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """accuracy, sensitivity, specificity and kappa from a confusion table."""
    k = {x: F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("n"))), F.lit(0)).cast("double").alias(x) for x in ("TP", "FP", "TN", "FN")}
    got = table.groupBy(*keys).agg(*k.values())
    tp, fp, tn, fn = (F.col(x) for x in ("TP", "FP", "TN", "FN"))
    n = tp + fp + tn + fn
    accuracy = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return got.select(
        *keys, accuracy.alias("accuracy"), F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(accuracy - chance, 1 - chance).alias("kappa"),
    )


def lift_gain(df: DataFrame, keys: Sequence[str], row: str, actual: str = "actual", score: str = "predicted", groups: int = 10) -> DataFrame:
    """Rows by score in equal groups (the rest in the last): rates, lift and cumulated gain."""
    spot = lambda no, n: (F.least(F.floor((no - 1) / F.greatest(F.floor(n / groups), F.lit(1))), F.lit(groups - 1)) + 1).cast("int")
    placed = bucketed(df, keys, [f"-{score}", row], "prediction_group", spot)
    sums = placed.groupBy(*keys, "prediction_group").agg(
        F.avg(actual).alias("sensitivity"), F.sum(actual).cast("double").alias("model_count"), F.count(F.lit(1)).alias("n"), F.count(actual).alias("_known")
    )
    rated = attach(settle(sums, "groups"), keys, {"_hits": F.sum("model_count"), "_among": F.sum("_known")})
    sums = rated.select(*keys, "prediction_group", F.try_divide("_hits", "_among").alias("baseline_rate"), "sensitivity", "model_count", "n")
    sums = sums.withColumns(
        {"baseline_count": F.col("n") * F.col("baseline_rate"), "lift_model": F.try_divide("sensitivity", "baseline_rate"), "lift_baseline": F.lit(1.0)}
    )
    return running(
        sums, keys, ["prediction_group"],
        {"n_cumulative": ("sum", F.col("n")), "gain_model": ("sum", F.col("model_count")), "gain_baseline": ("sum", F.col("baseline_count"))},
    )


def normalize_importances(df: DataFrame, keys: Sequence[str], how: str = "minmax") -> DataFrame:
    """Absolute values, then min-max times 100, or z-score ('zscore', also called 'scale')."""
    if how not in ("minmax", "zscore", "scale"):
        raise ValueError(f"normalization not valid: {how}")
    v = F.abs("value")
    out = attach(df, keys, {"_lo": F.min(v), "_hi": F.max(v), "_m": F.avg(v), "_s": F.stddev_samp(v)})
    value = F.try_divide(100 * (v - F.col("_lo")), F.col("_hi") - F.col("_lo")) if how == "minmax" else F.try_divide(v - F.col("_m"), F.col("_s"))
    return out.withColumn("value", value).drop("_lo", "_hi", "_m", "_s")


def weighted_importances(importances: DataFrame, model_scores: DataFrame) -> DataFrame:
    """(feature, score): median importance per model scaled to [0, 1], times the model's share of the median scores."""
    typical = quantiles(importances, ["model", "feature"], "value", {"value": 0.5})
    unit = attach(typical, ["model"], {"_lo": F.min("value"), "_hi": F.max("value")})
    unit = unit.withColumn("value", F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    share = attach(quantiles(model_scores, ["model"], "value", {"score": 0.5}), [], {"_all": F.sum("score")})
    joined = unit.join(share.select("model", (F.col("score") / F.col("_all")).alias("_w")), "model")
    return joined.groupBy("feature").agg(F.sum(F.col("value") * F.col("_w")).alias("score"))


def importance_shares(importances: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """Importances of each fold scaled to sum 1; mean and sd per feature, best ones only."""
    share = attach(importances, [*keys, "fold"], {"_all": F.sum("value")}).withColumn("share", F.try_divide("value", "_all"))
    got = share.groupBy(*keys, "feature").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"))
    return top_rows(got, keys, ["-mean", "feature"], top)


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """How often each value of each parameter was best: (model, variable, value, n)."""
    return parameters.groupBy("model", "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def dependence_band(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, low and high (mean -/+ sd) of the predictions per grid point."""
    got = curves.groupBy(*keys).agg(F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("_sd"))
    return got.select(*keys, "mean", (F.col("mean") - F.col("_sd")).alias("low"), (F.col("mean") + F.col("_sd")).alias("high"))


def vote(df: DataFrame, row: Sequence[str], label: str = "label", weights: Mapping[str, float] | None = None) -> DataFrame:
    """Majority (weighted) vote over the models; the smallest label wins ties."""
    w = F.lit(1.0)
    for model, value in (weights or {}).items():
        w = F.when(F.col("model") == model, F.lit(float(value))).otherwise(w)
    tally = df.groupBy(*row, label).agg(F.sum(w).alias("_votes"))
    return top_rows(tally, row, ["-_votes", label]).drop("_votes")


def average_prediction(df: DataFrame, row: Sequence[str], weights: Mapping[str, float] | None = None, quantile: float | None = None) -> DataFrame:
    """(row, probability, label): mean, weighted mean or quantile over the models; label 0 below .5."""
    if quantile is not None:
        got = df.groupBy(*row).agg(F.percentile("predicted", quantile).alias("probability"))  # one value per model
    else:
        w = F.lit(1.0)
        for model, value in (weights or {}).items():
            w = F.when(F.col("model") == model, F.lit(float(value))).otherwise(w)
        got = df.groupBy(*row).agg((F.sum(F.col("predicted") * w) / F.sum(w)).alias("probability"))
    return got.withColumn("label", (F.col("probability") >= 0.5).cast("int"))


def safe_class(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def safe_probabilities(c: Column, classes: int) -> Column:
    """The row's probabilities, or 1 / n each when any of them is missing or not finite."""
    bad = F.exists(c, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(c.isNull() | bad, F.array_repeat(F.lit(1.0 / classes), classes)).otherwise(c)


def resample_summary(score_tables: Mapping[str, DataFrame]) -> DataFrame:
    """Mean and sd of the fold scores per model, one pair of columns per score table."""
    parts = None
    for name, df in score_tables.items():
        part = df.select("model", F.lit(name).alias("_table"), "value")
        parts = part if parts is None else parts.unionByName(part)
    aggs = []
    for name in score_tables:
        v = F.when(F.col("_table") == name, F.col("value"))
        aggs += [F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"{name}_sd")]
    return parts.groupBy("model").agg(*aggs)


def metric_slice(score_table: DataFrame, metrics: Sequence[str], tasks: Sequence[str] | None = None) -> DataFrame:
    """Chosen metrics and tasks, models ordered by their mean value."""
    kept = score_table.where(F.col("metric").isin(list(metrics)))
    if tasks is not None:
        kept = kept.where(F.col("task").isin(list(tasks)))
    return attach(kept, ["model"], {"model_mean": F.avg("value")}).orderBy("model_mean", "model")


def baseline_probability(feature: Column) -> Column:
    """A feature read as a probability, clipped to [0, 1]."""
    return F.when(feature < 0, 0.0).when(feature > 1, 1.0).otherwise(feature.cast("double"))


def baseline_average(features: Mapping[str, float]) -> Column:
    """Weighted average of features; the weights must sum to 1."""
    if abs(sum(features.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    return functools.reduce(lambda a, b: a + b, [F.col(f"`{n}`") * w for n, w in features.items()])
