"""Window functions, ranking, top-k and set operations."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.skew import (
    affine,
    attach,
    bounded,
    join_on_keys,
    lookup,
    numbered,
    order_columns,
    reversed_order,
    running,
    tie_ranks,
    top_rows,
)


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group in the given order."""
    return top_rows(df, keys, reversed_order(order))


def first_per_group(df: DataFrame, keys: Sequence[str], rule: str = "order", order: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """One row per key.

    rule 'order': first in the order; 'fewest_nulls': fewest nulls over ``columns``, then
    the order; 'identical': all rows of a key must be equal, else an error.
    """
    if rule == "fewest_nulls":
        nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
        return top_rows(df.withColumn("_nulls", nulls), keys, ["_nulls", *order]).drop("_nulls")
    if rule == "identical":
        from tablemill.operators.checks import unique_rows

        return unique_rows(df.dropDuplicates(), list(keys))
    return top_rows(df, keys, order)


def top_category(df: DataFrame, entity: str, category: str, rank: str, deleted: str, keep: Column) -> DataFrame:
    """Primary category (highest rank among undeleted rows), then filtered by it."""
    live = df.where(F.col(deleted).isNull())
    return top_rows(live, [entity], [f"-{rank}", category]).select(entity, category).where(keep)


def sequence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    return numbered(df, keys, order, name)


def global_rank(df: DataFrame, order: Sequence[str], n: int, name: str = "position") -> DataFrame:
    """The first n rows with their position; the limit comes before the numbering."""
    return numbered(df.orderBy(*order_columns(order)).limit(n), [], order, name)


def lag_columns(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """``<column>.<i>``: the value i rows earlier (later for negative i)."""
    def at(c: str, i: int) -> Callable:
        return lambda w: F.lag(F.col(f"`{c}`"), i).over(w) if i >= 0 else F.lead(F.col(f"`{c}`"), -i).over(w)

    return bounded(
        df, keys, order, max(0, *lags), max(0, *[-i for i in lags]), {f"{c}.{i}": at(c, i) for c in columns for i in lags}
    )


_FRAME_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def lag_window_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    intervals: Sequence[tuple[int, int]],
    agg: str = "sum",
    fill: str | None = None,
) -> DataFrame:
    """``<column>.<a>.<b>``: aggregate over the values a to b rows back.

    fill None skips missing lags (a sum of nothing is 0); 'drop' removes rows with a
    missing lag; 'backfill' takes a missing lag from the next row that has it.
    """
    back = max(b for _, b in intervals)
    ahead = max(0, *[-a for a, _ in intervals])
    out = df
    source = {c: c for c in columns}
    if fill == "backfill":
        out = running(out, keys, reversed_order(order), {f"_next_{c}": ("last", F.col(f"`{c}`")) for c in columns})
        head = top_rows(out, keys, order).select(*keys, *[F.col(f"_next_{c}").alias(f"_head_{c}") for c in columns])
        out = join_on_keys(out, head, keys) if keys else out.withColumn("_h", head.select(F.struct("*")).scalar()).select("*", "_h.*").drop("_h")
        source = {c: f"_next_{c}" for c in columns}
    fold = {"sum": lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x), "mean": lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v),
            "min": F.array_min, "max": F.array_max}[agg]
    made: dict[str, Callable] = {}
    counts: dict[str, Callable] = {}
    for c in columns:
        for a, b in intervals:
            name = f"{c}.{a}.{b}"
            if fill == "backfill":
                def value(w, c=c, a=a, b=b):
                    seen = [F.coalesce(F.lag(source[c], i).over(w), F.when(F.lag(F.lit(1), i).over(w).isNull(), F.col(f"_head_{c}"))) for i in range(a, b + 1)]
                    return fold(F.filter(F.array(*[s.cast("double") for s in seen]), lambda x: x.isNotNull()))
            else:
                def value(w, c=c, a=a, b=b):
                    got = _FRAME_AGGREGATES[agg](F.col(f"`{c}`")).over(w.rowsBetween(-b, -a))
                    return F.coalesce(got.cast("double"), F.lit(0.0)) if agg == "sum" else got
            made[name] = value
            counts[f"_n_{name}"] = lambda w, c=c, a=a, b=b: F.count(F.col(f"`{c}`")).over(w.rowsBetween(-b, -a))
    if fill != "drop":
        done = bounded(out, keys, order, back, ahead, made)
        return done.drop(*[f"_next_{c}" for c in columns], *[f"_head_{c}" for c in columns])
    done = bounded(out, keys, order, back, ahead, made | counts)
    whole = F.lit(True)
    for c in columns:
        for a, b in intervals:
            whole = whole & (F.col(f"`_n_{c}.{a}.{b}`") == b - a + 1)
    return done.where(whole).drop(*counts)


def aggregate_delta(df: DataFrame, columns: Sequence[str], first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """``<column>.<a>:<b>.<c>:<d>``: difference of two lag window aggregates."""
    new = {}
    for c in columns:
        one, two = f"`{c}.{first[0]}.{first[1]}`", f"`{c}.{second[0]}.{second[1]}`"
        new[f"{c}.{first[0]}:{first[1]}.{second[0]}:{second[1]}"] = F.col(one) - F.col(two)
    return df.withColumns(new)


def forward_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "delta") -> DataFrame:
    """Next value minus this one; null on the last row."""
    return bounded(df, keys, order, 0, 1, {name: lambda w: F.lead(value).over(w) - F.col(value)})


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, center: bool = False, min_periods: int = 1, name: str = "rolling"
) -> DataFrame:
    """Mean over a window of rows, trailing or centred; null with fewer than min_periods values."""
    ahead = (size - 1) // 2 if center else 0
    back = size - 1 - ahead

    def mean(w):
        frame = w.rowsBetween(-back, ahead)
        return F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame))

    return bounded(df, keys, order, back, ahead, {name: mean})


def trailing_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, name: str) -> DataFrame:
    return bounded(df, keys, order, size - 1, 0, {name: lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(-(size - 1), 0)), F.lit(0.0))})


def smoothed(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], rate: float) -> DataFrame:
    """Exponential smoothing z = rate * x + (1 - rate) * z, starting at the first value; ``values`` maps new names to columns.

    A missing value leaves z as it is; rows before the first value have none. Rate 0 keeps the first
    value, rate 1 takes each value as it is.
    """
    if not 0 <= rate <= 1:
        raise ValueError(f"rate {rate} is not between 0 and 1")
    return affine(df, keys, order, {n: (F.lit(1.0 - rate), rate * F.col(c), F.col(c)) for n, c in values.items()})


def trailing_sum_ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, rate: float = 0.2, name: str = "smooth") -> DataFrame:
    """Trailing n-row sum, then exponential smoothing."""
    return smoothed(trailing_sum(df, keys, order, value, size, "_sum"), keys, order, {name: "_sum"}, rate).drop("_sum")


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of Beta(a, b): bisection on the regularised incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    log_beta = np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a, b)])

    def fraction(x, a, b):
        """Continued fraction of the incomplete beta function (modified Lentz)."""
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        return h

    def share(x):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta)
        direct = x < (a + 1) / (a + b + 2)
        left = front * fraction(np.where(direct, x, 0.5), a, b) / a
        right = 1 - front * fraction(np.where(direct, 0.5, 1 - x), b, a) / b
        return np.where(direct, left, right)

    low, high = np.full_like(a, 1e-300), np.full_like(a, 1 - 1e-16)
    for _ in range(100):
        middle = (low + high) / 2
        under = share(middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def beta_lower_bound(
    df: DataFrame, group: str, event: str, day: str, value: str, size: str, rows: int = 30, prior: tuple[float, float] = (1.0, 1.0), p: float = 0.025
) -> DataFrame:
    """Per (group, event, day): posterior alpha and beta from smoothed trailing sums, the share and its lower bound."""
    keys, frame = [group, event], lambda w: w.rowsBetween(-(rows - 1), 0)
    sums = {f"_sum_{c}": lambda w, c=c: F.coalesce(F.sum(c).over(frame(w)), F.lit(0.0)) for c in (value, size)}
    summed = smoothed(bounded(df, keys, [day], rows - 1, 0, sums), keys, [day], {"_value": f"_sum_{value}", "_size": f"_sum_{size}"}, 0.2).drop(*sums)

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(p, a.to_numpy(), b.to_numpy()))

    out = summed.withColumns({"alpha": prior[0] + F.col("_value"), "beta": F.col("_size") - F.col("_value") + prior[1]})
    out = out.withColumns({"fraction": F.try_divide(value, size), "lower": bound("alpha", "beta")})
    return out.drop("_value", "_size")


def daily_score(bounds: DataFrame, group: str, day: str) -> DataFrame:
    """Sum of the lower bounds over the events of a group and day."""
    return bounds.groupBy(group, day).agg(F.sum("lower").alias("score"))


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], static: Sequence[str] = (), timed: Sequence[str] = ()) -> DataFrame:
    """Static columns forward then backward, timed columns forward only."""
    names = [*static, *timed]
    out = running(df, keys, order, {f"_f_{c}": ("last", F.col(f"`{c}`")) for c in names})
    if static:
        out = running(out, keys, reversed_order(order), {f"_b_{c}": ("last", F.col(f"`{c}`")) for c in static})
    filled = {c: F.coalesce(f"`_f_{c}`", f"`_b_{c}`") if c in static else F.col(f"`_f_{c}`") for c in names}
    return out.withColumns(filled).drop(*[f"_f_{c}" for c in names], *[f"_b_{c}" for c in static])


def elapsed_minutes(df: DataFrame, entity: str, time: str, event_time: str) -> DataFrame:
    """Minutes since an external event and since the entity's first row.

    An entity whose first row does not lie after its event gets null for the former.
    """
    out = attach(df, [entity], {"_first": F.min(time)})
    since = (F.unix_seconds(time) - F.unix_seconds(event_time)) / 60
    first = (F.unix_seconds("_first") - F.unix_seconds(event_time)) / 60
    return out.withColumns(
        {"since_event": F.when(first > 0, since), "since_first": (F.unix_seconds(time) - F.unix_seconds("_first")) / 60}
    ).drop("_first")


def since_last_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], event: str, name: str = "steps") -> DataFrame:
    """Rows since the last true event: 0 at an event, null before the first. Null events are an error."""
    checked = F.when(F.col(event).isNull(), F.raise_error(F.lit("event series must not be null")).cast("boolean")).otherwise(F.col(event))
    out = running(df.withColumn("_event", checked), keys, order, {"_quiet": ("count", F.when(~F.col("_event"), 1))})
    out = running(out, keys, order, {"_at": ("last", F.when(F.col("_event"), F.col("_quiet")))})
    return out.withColumn(name, F.col("_quiet") - F.col("_at")).drop("_event", "_quiet", "_at")


def running_share(df: DataFrame, entity: str, value: str, buckets: int = 10) -> DataFrame:
    """Totals and cumulative totals by bucket of the entities ranked by value, smallest first."""
    totals = df.groupBy(entity).agg(F.sum(value).alias("_v"))
    ranked = attach(numbered(totals, [], ["_v", entity], "_no"), [], {"_n": F.count(F.lit(1))})
    bucket = F.ceil(F.lit(buckets) * F.col("_no") / F.col("_n")).cast("int").alias("bucket")
    sums = ranked.groupBy(bucket).agg(F.sum("_v").alias("total"))
    return running(sums, [], ["bucket"], {"cumulative": ("sum", F.col("total"))})


def percent_rank_average(df: DataFrame, keys: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """Average-tie ranks scaled so that the smallest is 0 and the largest 1."""
    ranks = tie_ranks(df, keys, value)
    scaled = attach(ranks, keys, {"_lo": F.min("avg_rank"), "_hi": F.max("avg_rank")})
    share = F.try_divide(F.col("avg_rank") - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias(name)
    return lookup(df, scaled.select(*keys, value, share), [*keys, value])


def percentile_bucket(df: DataFrame, keys: Sequence[str], value: str, buckets: int, null_share: float = 0.0, name: str = "bucket") -> DataFrame:
    """Dense rank / largest dense rank, floored into n buckets; boundaries fall into the lower bucket."""
    ranks = tie_ranks(df, keys, value)
    scaled = attach(ranks, keys, {"_top": F.max("dense")})
    joined = lookup(df, scaled.select(*keys, value, (F.col("dense") / F.col("_top")).alias("_share")), [*keys, value])
    share = F.coalesce("_share", F.lit(min(max(null_share, 0.0), 1.0))) * (1.0 - 2**-53)
    return joined.withColumn(name, F.floor(share / (1 / buckets)) * (1 / buckets)).drop("_share")


def distinct_per_entity(df: DataFrame, entity: str, item: str, name: str = "items") -> DataFrame:
    """Number of distinct items of the entity, on every row."""
    return lookup(df, df.groupBy(entity).agg(F.countDistinct(item).alias(name)), [entity])


def cumulative_history(df: DataFrame, entity: str, year: str, values: Sequence[str], current: int) -> DataFrame:
    """Rows of the current year with sums of earlier years by age (1, 2, 3 and 4+ years), 0 when none."""
    age = F.lit(current) - F.col(year)
    aggs = []
    for v in values:
        for k, label in ((1, "1yr"), (2, "2yr"), (3, "3yr"), (4, "4+yr")):
            hit = (age == k) if k < 4 else (age >= 4)
            aggs.append(F.sum(F.when(hit, F.col(v))).alias(f"{v}:{label}"))
    past = df.where(F.col(year) < current).groupBy(entity).agg(*aggs)
    now = df.where(F.col(year) == current).withColumnsRenamed({v: f"{v}:0yr" for v in values})
    names = [c for c in past.columns if c != entity]
    return now.join(past, entity, "left").fillna(0, names)


def top_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order_columns(order)).limit(n)


def nth_value(df: DataFrame, value: str, n: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """Value at 1-based rank n from below; no row for a missing, non-positive or too large rank."""
    ranks = tie_ranks(df, list(keys), value)
    hit = F.lit(False) if n is None or n <= 0 else (F.col("below") < n) & (F.col("below") + F.col("n") >= n)
    return ranks.where(hit).select(*keys, value)


def union_all(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks become typed nulls."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def _membership(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    one, zero = F.lit(1), F.lit(0)
    both = a.select(column, one.alias("in_a"), zero.alias("in_b")).unionByName(b.select(column, zero.alias("in_a"), one.alias("in_b")))
    return both.groupBy(column).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def set_report(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(part, n, percent of the union) for both, one_only per side, either alone, and all."""
    members = _membership(a, b, column)
    x, y = F.col("in_a"), F.col("in_b")
    counts = members.agg(
        F.struct(
            F.coalesce(F.sum(x * y), F.lit(0)).alias("both"), F.coalesce(F.sum(x * (1 - y)), F.lit(0)).alias("left"),
            F.coalesce(F.sum(y * (1 - x)), F.lit(0)).alias("right"), F.count(F.lit(1)).alias("all"),
        ).alias("c")
    )
    part = lambda n, c: F.struct(F.lit(n).alias("part"), c.alias("n"))
    left, right = F.col("c.left"), F.col("c.right")
    rows = F.array(
        part("both", F.col("c.both")), part("only_one", left + right), part("only_left", left), part("only_right", right), part("all", F.col("c.all"))
    )
    return counts.select("c", F.inline(rows)).select("part", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), "c.all"), F.lit(0.0)).alias("percent"))


def set_members(a: DataFrame, b: DataFrame, column: str, part: str) -> DataFrame:
    """Members of one part of :func:`set_report`."""
    rules = {"both": "in_a = 1 AND in_b = 1", "only_left": "in_b = 0", "only_right": "in_a = 0", "only_one": "in_a + in_b = 1", "all": "true"}
    return _membership(a, b, column).where(rules[part]).select(column)


def without(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of a whose value is not in b; repeated rows stay."""
    return a.join(b.select(column), column, "left_anti")
