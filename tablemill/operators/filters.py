"""Row and column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.skew import attach, join_on_keys, quantiles, running


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


class Report:
    """Counts over a table, computed when ``get`` is first read; nothing is left behind in the session."""

    def __init__(self, counts: DataFrame):
        self._counts, self._values = counts, None

    @property
    def get(self) -> dict:
        if self._values is None:
            self._values = self._counts.first().asDict()
        return self._values


def subset_with_report(df: DataFrame, keep: Column) -> tuple[DataFrame, Report]:
    """Filter; the report holds before, after, removed and the removed percentage."""
    kept = F.coalesce(keep, F.lit(False))
    before, after = F.count(F.lit(1)), F.count(F.when(kept, 1))
    share = F.coalesce(F.try_divide(100.0 * (before - after), before), F.lit(0.0))
    counts = df.agg(before.alias("before"), after.alias("after"), (before - after).alias("removed"), share.alias("removed_percent"))
    return df.where(kept), Report(counts)


def exclude_containing(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Drop rows whose text contains one of the words, case ignored."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(column).contains(w.lower())
    return df.where(~F.coalesce(hit, F.lit(False)))


def drop_sparse_columns(df: DataFrame, max_nulls: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that are all null, or have more than ``max_nulls`` nulls."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    limit = counts["_rows"] - 1 if max_nulls is None else max_nulls
    gone = [c for c in df.columns if c not in keep and counts["_rows"] - counts[c] > limit]
    return df.drop(*gone)


def drop_sparse_rows(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Drop rows whose share of nulls over the columns exceeds the threshold."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.where(nulls / len(columns) <= threshold)


def min_observations(df: DataFrame, keys: Sequence[str], column: str, window_size: float, threshold: float) -> DataFrame:
    """Keep groups whose non-null count per window reaches the threshold."""
    counted = attach(df, keys, {"_seen": F.count(column)})
    return counted.where(F.col("_seen") / window_size >= threshold).drop("_seen")


def truncate_after_event(df: DataFrame, entity: str, time: str, value: str, entities: Sequence) -> DataFrame:
    """For listed entities keep the rows before the first non-positive value.

    A listed entity without such a row loses all rows; others are untouched.
    """
    listed = F.col(entity).isin(list(entities))
    first = df.where(listed & (F.col(value) <= 0)).groupBy(entity).agg(F.min(time).alias("_stop"))
    joined = df.join(first, entity, "left")
    return joined.where(~listed | F.coalesce(F.col(time) < F.col("_stop"), F.lit(False))).drop("_stop").select(*df.columns)


def top_entities(df: DataFrame, entity: str, response: str, share: float) -> DataFrame:
    """Rows of the best floor(n * share) entities by mean response; ties by entity."""
    means = df.groupBy(entity).agg(F.avg(response).alias("_mean"))
    ranked = running(means, [], ["-_mean", entity], {"_no": ("count", F.lit(1))})
    limit = means.agg(F.floor(F.count(F.lit(1)) * share).alias("n"))
    best = ranked.where(F.col("_no") <= limit.scalar()).select(entity)
    return df.join(best, entity, "left_semi")


def align_indicator_columns(train: DataFrame, holdout: DataFrame, indicators: Sequence[str], minimum: int) -> tuple[DataFrame, DataFrame]:
    """Drop indicators with a training total below the minimum; give the holdout the rest, 0 where absent."""
    totals = train.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in indicators]).first()
    kept = [c for c in indicators if totals[c] >= minimum]
    plain = [c for c in holdout.columns if c not in indicators]
    filled = [F.col(f"`{c}`") if c in holdout.columns else F.lit(0).alias(c) for c in kept]
    return train.drop(*[c for c in indicators if c not in kept]), holdout.select(*[f"`{c}`" for c in plain], *filled)


def null_outliers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """asinh, then null outside [p10 - r, p90 + r] with r = p90 - p10."""
    out = df.withColumns({c: F.asinh(F.col(c)) for c in columns})
    for c in columns:
        cuts = quantiles(out, list(keys), c, {"_p10": 0.1, "_p90": 0.9})
        if keys:
            out = join_on_keys(out, cuts, keys)
        else:
            out = out.withColumn("_cuts", cuts.select(F.struct("_p10", "_p90")).scalar())
            out = out.withColumns({"_p10": F.col("_cuts._p10"), "_p90": F.col("_cuts._p90")}).drop("_cuts")
        low, high = F.col("_p10"), F.col("_p90")
        inside = F.col(c).between(low - (high - low), high + (high - low))
        out = out.withColumn(c, F.when(inside, F.col(c))).drop("_p10", "_p90")
    return out
