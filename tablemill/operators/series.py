"""Reshaping and time series."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.times import DAY
from tablemill.skew import attach, bounded, running, same_rows

REQUIRED = ("entity_id", "account_id", "count_type", "metric_id", "unix_seconds", "value")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value", drop_nulls: bool = True) -> DataFrame:
    """Wide to long."""
    out = df.unpivot(list(ids), [F.col(f"`{c}`") for c in columns], variable, value)
    return out.where(F.col(value).isNotNull()) if drop_nulls else out


def pivot(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Long to wide over known values; more than one row per cell is an error."""
    cells = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
    repeated = F.raise_error(F.concat(F.lit("several rows in one cell: "), F.to_json(F.struct(*keys, column))))
    single = F.when(F.col("_n") == 1, F.col("_v")).otherwise(repeated.cast(df.schema[value].dataType))
    wide = cells.withColumn("_v", single).groupBy(*keys).pivot(column, list(values)).agg(F.first("_v", ignorenulls=True))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def metric_tables_union(tables: Mapping[str, DataFrame], games: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Many wide stat tables to one long table (``<type>:<column>``), then a single join to the games."""
    parts = []
    for kind, df in tables.items():
        stats = [c for c in df.columns if c not in ids]
        texts = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(f"{kind}:{c}") for c in stats])
        parts.append(melt(texts, ids, [f"{kind}:{c}" for c in stats], "metric", "value"))
    long = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return games.join(long, list(keys))


def _line(x: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Value at x of the line through two points; the ends are returned unchanged."""
    inner = v0 + (v1 - v0) * ((x - t0) / (t1 - t0))
    return F.when(x == t0, v0).when(x == t1, v1).otherwise(inner)


def _steps_between(t: Column, following: Column, first: Column, step: int) -> Column:
    """Grid times strictly between a point and the next one; the grid starts at the series' first time."""
    start = first + (F.floor((t - first) / step) + 1) * step
    return F.when(start < following, F.sequence(start, following - 1, F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def daily_interpolate(df: DataFrame, keys: Sequence[str], time: str = "unix_seconds", value: str = "value", step: int = DAY) -> DataFrame:
    """Insert the missing days between the first and last time, values on a straight line.

    Adds ``is_interpolated``. Times off the daily grid are kept as given. Every row
    produces the gap that follows it, so nothing is joined or filled.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(time).cast("long").alias(time), F.col(value).cast("double").alias(value))
    out = attach(known, keys, {"_first": F.min(time)}, order=[time])
    out = bounded(out, keys, [time], 0, 1, {"_t1": lambda w: F.lead(time).over(w), "_v1": lambda w: F.lead(value).over(w)})
    t, v, t1, v1 = F.col(time), F.col(value), F.col("_t1"), F.col("_v1")
    gap = F.when(t1.isNotNull(), _steps_between(t, t1, F.col("_first"), step)).otherwise(F.array().cast("array<bigint>"))
    rows = out.select(*keys, t.alias("_t0"), v.alias("_v0"), "_t1", "_v1", F.explode(F.concat(F.array(t), gap)).alias(time))
    at = F.col(time)
    return rows.select(
        *keys, time, _line(at, F.col("_t0"), F.col("_v0"), F.col("_t1"), F.col("_v1")).alias(value), (at != F.col("_t0")).alias("is_interpolated")
    )


def unstack_timeseries(df: DataFrame, dimensions: Sequence[str] = (), pre_aggregated: Sequence[int] = ()) -> DataFrame:
    """Total and delta for every point of each (entity, account, metric [, dimensions]) series.

    Totals only: missing days are filled on a straight line and flagged, delta = next
    total - total. Deltas only: total and flag are null, the last delta is null.
    Pre-aggregated metrics: both as given, the last delta null. A series with totals that
    is not pre-aggregated ignores its delta rows. Two rows of a count type at one time
    are an error.
    """
    missing = [c for c in (*REQUIRED, *dimensions) if c not in df.columns]
    if missing:
        raise ValueError(f"required fields not found: {missing}")
    keys = ["entity_id", "account_id", "metric_id", *dimensions]
    value, kind = F.col("value").cast("double"), F.col("count_type")
    points = df.where(kind.isin("t", "d")).groupBy(*keys, F.col("unix_seconds").cast("long").alias("unix_seconds")).agg(
        F.max(F.when(kind == "t", value)).alias("total"),
        F.max(F.when(kind == "d", value)).alias("given"),
        F.count(F.when(kind == "t", 1)).alias("_nt"),
        F.count(F.when(kind == "d", 1)).alias("_nd"),
    )
    twice = F.raise_error(F.concat(F.lit("several values of one count type at "), F.to_json(F.struct(*keys, "unix_seconds"))))
    points = points.withColumn("_nt", F.when((F.col("_nt") > 1) | (F.col("_nd") > 1), twice.cast("long")).otherwise(F.col("_nt")))
    ts = F.col("unix_seconds")
    points = attach(
        points, keys,
        {
            "_totals": F.max("_nt"),
            "_first": F.min(F.when(F.col("total").isNotNull(), ts)),
            "_last_delta": F.max(F.when(F.col("_nd") > 0, ts)),
        },
        order=["unix_seconds"],
    )
    ready = F.col("metric_id").isin(list(pre_aggregated))
    filled = ~ready & (F.col("_totals") > 0)
    points = same_rows(points.withColumn("_filled", filled).where(~F.col("_filled") | F.col("total").isNotNull()), points)
    points = bounded(points, keys, ["unix_seconds"], 0, 1, {"_t1": lambda w: F.lead("unix_seconds").over(w), "_v1": lambda w: F.lead("total").over(w)})
    empty = F.array().cast("array<bigint>")
    gap = F.when(F.col("_filled") & F.col("_t1").isNotNull(), _steps_between(ts, F.col("_t1"), F.col("_first"), DAY)).otherwise(empty)
    # each stop is paired with the stop after it: the gap's days, then the next given point
    begins, ends = F.concat(F.array(ts), gap), F.concat(gap, F.array(F.col("_t1")))
    rows = points.select(
        *keys, ts.alias("_t0"), F.col("total").alias("_v0"), "_t1", "_v1", "given", "_filled", "_nt", "_last_delta",
        F.explode(F.arrays_zip(begins.alias("at"), ends.alias("until"))).alias("_s"),
    )
    at, until = F.col("_s.at"), F.col("_s.until")
    line = lambda x: _line(x, F.col("_t0"), F.col("_v0"), F.col("_t1"), F.col("_v1"))
    given = F.when(at != F.col("_last_delta"), F.col("given"))
    return rows.select(
        *keys,
        at.alias("unix_seconds"),
        F.when(F.col("_filled"), line(until) - line(at)).otherwise(given).alias("delta_value"),
        F.when(F.col("_filled"), line(at)).otherwise(F.col("_v0")).alias("total_value"),
        F.when(F.col("_nt") > 0, at != F.col("_t0")).alias("is_interpolated"),
    )


def grid_interpolate(
    df: DataFrame, keys: Sequence[str], time: str, value: str, step: int, limit: int | None = None, extend: bool = True
) -> DataFrame:
    """Re-index to a fixed grid from the first time; linear values, off-grid rows are lost.

    ``limit`` fills at most that many steps of a gap. Steps after the last value keep it
    (within the limit), steps before the first are null. The grid ends at the first step
    not before the last time (``extend``), or at the last step not after it.
    """
    slim = df.select(*keys, F.col(time).cast("long").alias(time), F.col(value).cast("double").alias(value))
    spans = attach(slim, keys, {"_lo": F.min(time), "_hi": F.max(time)}, order=[time])
    on_grid = spans.where(((F.col(time) - F.col("_lo")) % step == 0) & F.col(value).isNotNull())
    linked = bounded(
        on_grid, keys, [time], 1, 1,
        {"_t1": lambda w: F.lead(time).over(w), "_v1": lambda w: F.lead(value).over(w), "_before": lambda w: F.lag(time).over(w)},
    )
    size = (F.col("_hi") - F.col("_lo")) / step
    last = F.col("_lo") + (F.ceil(size) if extend else F.floor(size)) * step
    stop = F.coalesce(F.col("_t1") - step, last)
    start = F.when(F.col("_before").isNull(), F.col("_lo")).otherwise(F.col(time))
    rows = linked.withColumn("_at", F.explode(F.sequence(start, stop, F.lit(step))))
    at, t0, v0 = F.col("_at"), F.col(time), F.col(value)
    filled = F.when(F.col("_t1").isNull(), v0).otherwise(_line(at, t0, v0, F.col("_t1"), F.col("_v1")))
    allowed = F.lit(True) if limit is None else (at - t0) / step <= limit
    return rows.select(*keys, at.alias(time), F.when((at >= t0) & allowed, filled).alias(value))


def monthly_reindex(df: DataFrame, entity: str, month: str, static: Sequence[str] = (), timed: Sequence[str] = ()) -> DataFrame:
    """Month grid per entity with an ``interpolated`` flag.

    Static columns are filled both ways, timed columns forward. Entities with one row
    pass through; a null month in a longer entity is an error. Each row is repeated for
    the months until the next one, which is what a forward fill gives.
    """
    from tablemill.operators.windows import fill_gaps

    counted = attach(df, [entity], {"_rows": F.count(F.lit(1))})
    bad = (F.col("_rows") > 1) & F.col(month).isNull()
    message = F.concat(F.lit("null month for entity "), F.col(entity).cast("string"))
    counted = counted.withColumn(month, F.when(bad, F.raise_error(message).cast("date")).otherwise(F.col(month)))
    filled = fill_gaps(counted, [entity], [month], static, timed)
    filled = bounded(filled, [entity], [month], 0, 1, {"_next": lambda w: F.lead(month).over(w)})
    until = F.coalesce(F.add_months("_next", -1), F.col(month))
    months = F.when(F.col(month).isNull(), F.array(F.lit(None).cast("date"))).otherwise(F.sequence(F.col(month), until, F.expr("interval 1 month")))
    rows = filled.withColumn("_at", F.explode(months))
    flag = F.coalesce(F.col("_at") != F.col(month), F.lit(False))
    return rows.withColumn("interpolated", flag).withColumn(month, F.col("_at")).drop("_at", "_next", "_rows").select(*df.columns, "interpolated")


def calendar_counts(df: DataFrame, time: str, category: str, values: Sequence[str]) -> DataFrame:
    """Events per month and category (0 when none), with the mean over the categories."""
    wide = df.groupBy(F.trunc(time, "month").alias("month")).pivot(category, list(values)).count().fillna(0, list(values))
    total = functools.reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    return wide.withColumn("mean", total / len(values))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return running(df, keys, order, {name: ("sum", F.col(value))})
