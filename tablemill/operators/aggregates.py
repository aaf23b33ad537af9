"""Aggregations."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import numbers
from tablemill.operators.joins import paired_mentions
from tablemill.session import settle
from tablemill.skew import (
    attach,
    bounded,
    join_on_keys,
    lookup,
    most_common,
    numbered,
    order_columns,
    quantiles,
    rows_per_slice,
    running,
    same_rows,
    spread,
    top_rows,
)

# How a metric rolls up over the players of a game.
MAX_SUFFIXES = ("Lg",)
WEIGHTED_METRICS = {
    "passing:YPA": "passing:Att",
    "passing:Rate": "passing:Att",
    "rushing:Avg": "rushing:Att",
    "receiving:Avg": "receiving:Rec",
    "kickoff_returns:Avg": "kickoff_returns:Num",
    "punt_returns:Avg": "punt_returns:Num",
    "kickoffs:Avg": "kickoffs:Num",
    "punting:Avg": "punting:Punts",
}
MEAN_SUFFIXES = (":Avg", ":Rate", ":Lg", ":YPA")
ROLLUP_MODES = ("player_first", "team_first", "team_second")
PROFILE_SHARES = (0.5, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.5)


def group_sum(df: DataFrame, keys: Sequence[str], value: str, name: str, ordered: bool = True) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return out.orderBy(*order_columns([f"-{name}", *keys])) if ordered else out


def pair_affinity(
    df: DataFrame, actor: str, target: str, followers: str, first: Sequence, second: Sequence, distinct: bool = False
) -> DataFrame:
    """Followers summed over the actors that mention both targets of a pair."""
    pairs = paired_mentions(df, actor, target, followers, first, second, distinct)
    return group_sum(pairs, ["target_a", "target_b"], "weight", "affinity")


def min_per_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(name))


def distinct_counts(df: DataFrame, key: str, item: str, approximate: bool = False) -> DataFrame:
    """Distinct items per group, largest first, with a ``name [n]`` label."""
    count = F.approx_count_distinct(item) if approximate else F.countDistinct(item)
    out = df.groupBy(key).agg(count.alias("n"))
    return out.withColumn("label", F.format_string("%s [%d]", F.col(key).cast("string"), F.col("n"))).orderBy(F.desc("n"), key)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Frequency of every value and its share within the group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return attach(counts, keys, {"_all": F.sum("n")}).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def metric_rollup(df: DataFrame, keys: Sequence[str], mode: str = "team_first") -> DataFrame:
    """Roll (player, metric, value) rows up per group and metric.

    Metrics with a MAX suffix take the maximum; a weighted metric whose weight metric is
    present in the group takes the weighted mean over players; the rest are summed.
    ``player_first`` always sums.
    """
    if mode not in ROLLUP_MODES:
        raise ValueError(f"aggregation type not supported: {mode}")
    if mode == "player_first":
        return df.groupBy(*keys, "metric").agg(F.sum("value").alias("value"))
    # a weight row also serves each metric it weighs, so no self-join is needed
    served: dict[str, list[str]] = {}
    for metric, weight in WEIGHTED_METRICS.items():
        served.setdefault(weight, []).append(metric)
    targets = F.array(F.struct(F.col("metric").alias("metric"), F.lit(False).alias("is_weight")))
    for weight, metrics in served.items():
        extra = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(True).alias("is_weight")) for m in metrics])
        targets = F.when(F.col("metric") == weight, F.concat(targets, extra)).otherwise(targets)
    rows = df.select(*keys, "player", "value", F.explode(targets).alias("_to")).select(
        *keys, "player", F.col("_to.metric").alias("metric"), F.col("_to.is_weight").alias("w"), "value"
    )
    cells = rows.groupBy(*keys, "player", "metric").agg(
        F.sum(F.when(~F.col("w"), F.col("value"))).alias("v"),
        F.sum(F.when(F.col("w"), F.col("value"))).alias("w"),
        F.max(F.when(~F.col("w"), F.col("value"))).alias("top"),
    )
    total = cells.groupBy(*keys, "metric").agg(
        F.sum("v").alias("v"), F.max("top").alias("top"), F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("vw"),
        F.count("top").alias("seen"),
    )
    suffix = F.element_at(F.split("metric", ":"), -1)
    value = (
        F.when(suffix.isin(*MAX_SUFFIXES), F.col("top"))
        .when(F.col("metric").isin(*WEIGHTED_METRICS) & F.col("w").isNotNull(), F.try_divide("vw", "w"))
        .otherwise(F.col("v"))
    )
    return total.where("seen > 0").select(*keys, "metric", value.alias("value"))


def metric_rollup_by_suffix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean for metrics ending in a rate suffix, else sum."""
    is_rate = F.lit(False)
    for s in MEAN_SUFFIXES:
        is_rate = is_rate | F.col("metric").endswith(s)
    got = df.groupBy(*keys, "metric").agg(F.avg("value").alias("_mean"), F.sum("value").alias("_sum"))
    return got.select(*keys, "metric", F.when(is_rate, F.col("_mean")).otherwise(F.col("_sum")).alias("value"))


def per_game_average(df: DataFrame, keys: Sequence[str], game: str, cells: Sequence[str], value: str = "value") -> DataFrame:
    """Sum per (keys, cells) over the number of distinct games of the keys."""
    games = df.groupBy(*keys).agg(F.countDistinct(game).alias("games"))
    sums = df.groupBy(*keys, *cells).agg(F.sum(value).alias("_sum"))
    return join_on_keys(sums, games, keys).select(*keys, *cells, "games", (F.col("_sum") / F.col("games")).alias("value"))


def strength_adjusted(df: DataFrame, ranks: DataFrame, keys: Sequence[str], cells: Sequence[str], game: str) -> DataFrame:
    """Rows (keys, cells, damping, n, v, a): a = sum(value * rank of the opponent) / games.

    ``ranks`` holds (damping, opponent, rank); opponents without one count as
    1 / number of ranked opponents of that damping.
    """
    games = df.groupBy(*keys).agg(F.countDistinct(game).alias("n"))
    per_opponent = df.groupBy(*keys, *cells, "opponent").agg(F.sum("value").alias("value"))
    defaults = ranks.groupBy("damping").agg((1.0 / F.countDistinct("opponent")).alias("_default"))
    options = defaults.agg(F.collect_list(F.struct("damping", "_default")))  # a handful of damping factors
    spread = per_opponent.withColumn("_all", options.scalar()).withColumn("_d", F.explode("_all")).select(
        *keys, *cells, "opponent", "value", F.col("_d.damping").alias("damping"), F.col("_d._default").alias("_default")
    )
    ranked = spread.join(ranks.select("damping", "opponent", "rank"), ["damping", "opponent"], "left")
    weight = F.coalesce("rank", "_default")
    sums = ranked.groupBy(*keys, *cells, "damping").agg(F.sum("value").alias("_v"), F.sum(F.col("value") * weight).alias("_a"))
    joined = join_on_keys(sums, games, keys)
    return joined.select(*keys, *cells, "damping", "n", (F.col("_v") / F.col("n")).alias("v"), (F.col("_a") / F.col("n")).alias("a"))


def resolve_adjusted(adjusted: DataFrame, ranks: DataFrame, opponent: str) -> DataFrame:
    """Adjusted value on the original scale: a / rank of the coming opponent."""
    defaults = ranks.groupBy("damping").agg((1.0 / F.countDistinct("opponent")).alias("_default"))
    faced = ranks.select("damping", F.col("opponent").alias(opponent), "rank")
    joined = adjusted.join(faced, ["damping", opponent], "left").join(defaults, "damping", "left")
    return joined.withColumn("adjusted", F.try_divide("a", F.coalesce("rank", "_default"))).drop("rank", "_default")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over rows with a weight; equal weights when they sum to 0."""
    known = weight.isNotNull()
    total = F.sum(F.when(known, weight))
    return F.when(total == 0, F.avg(F.when(known, value))).otherwise(F.try_divide(F.sum(value * weight), total))


def _net_passing() -> Column:
    return F.sum(F.col("`passing:Yds`") - F.col("`passing:Loss`"))


def profiles() -> dict[str, dict]:
    """Named statistics: input metrics, output expressions, weights of the outputs, main output."""
    c = lambda n: F.col(f"`{n}`")
    zero = F.lit(0.0)
    return {
        "passing": {
            "inputs": ["passing:Yds", "passing:YPA", "passing:Rate", "passing:Att", "passing:Loss"],
            "outputs": {
                "passing:Yds": _net_passing(),
                "passing:YPA": weighted_mean(c("passing:YPA"), c("passing:Att")),
                "passing:Rate": weighted_mean(c("passing:Rate"), c("passing:Att")),
            },
            "weights": {"passing:Yds": 0.5, "passing:YPA": 0.1, "passing:Rate": 0.4},
            "primary": "passing:Yds",
        },
        "rushing": {
            "inputs": ["rushing:Yds", "rushing:Att", "rushing:Avg"],
            "outputs": {
                "rushing:Yds": F.sum(c("rushing:Yds")),
                "rushing:Avg": weighted_mean(c("rushing:Avg"), c("rushing:Att")),
                "rushing:Att": F.sum(c("rushing:Att")),
            },
            "weights": {"rushing:Yds": 0.8, "rushing:Avg": 0.1, "rushing:Att": 0.1},
            "primary": "rushing:Avg",
        },
        "receiving": {
            "inputs": ["receiving:Yds", "receiving:Rec", "receiving:Avg"],
            "outputs": {
                "receiving:Yds": F.sum(c("receiving:Yds")),
                "receiving:Avg": weighted_mean(c("receiving:Avg"), c("receiving:Rec")),
                "receiving:Rec": F.sum(c("receiving:Rec")),
            },
            "weights": {"receiving:Yds": 0.8, "receiving:Avg": 0.1, "receiving:Rec": 0.1},
            "primary": "receiving:Yds",
        },
        "overall": {
            "inputs": ["passing:Yds", "passing:Loss", "rushing:Yds"],
            "outputs": {"overall:Yds": F.coalesce(_net_passing(), zero) + F.coalesce(F.sum(c("rushing:Yds")), zero)},
            "weights": {"overall:Yds": 1.0},
            "primary": "overall:Yds",
        },
    }


def profile_rollup(df: DataFrame, keys: Sequence[str], profile: Mapping) -> DataFrame:
    """Long player rows to one row per matchup with the outputs of a profile."""
    inputs = profile["inputs"]
    wide = df.where(F.col("metric").isin(inputs)).groupBy(*keys, "player").pivot("metric", inputs).agg(F.first("value"))
    return wide.groupBy(*keys).agg(*[v.alias(n) for n, v in profile["outputs"].items()])


def group_benchmark(df: DataFrame, values: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean of the finite values per group set as ``Bench<Name>.<column>``; null keys drop the row."""
    out = df
    for name, keys in groups.items():
        for k in keys:
            out = out.where(F.col(k).isNotNull())
        out = attach(out, list(keys), {f"Bench{name}.{v}": F.avg(numbers.finite(F.col(f"`{v}`"))) for v in values})
    return out


def quantile_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, max, mean, sd and eleven percentiles per group, nulls skipped."""
    v = F.col(value)
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.min(v).alias(f"{value}_min"), F.max(v).alias(f"{value}_max"), F.avg(v).alias(f"{value}_mean"), F.stddev_samp(v).alias(f"{value}_std")
    )
    return join_on_keys(stats, quantiles(df, keys, value, {f"{value}_p{int(p * 10)}": p / 100 for p in PROFILE_SHARES}), keys)


def threshold_counts(df: DataFrame, keys: Sequence[str], value: str, under: Sequence[float] = (), over: Sequence[float] = ()) -> DataFrame:
    """Count beyond each threshold and the mean of those values.

    Non-positive values are errors and ignored. The mean is the threshold itself when no
    value lies beyond it, and null when the group has no valid value.
    """
    v = F.when(F.col(value) > 0, F.col(value))
    aggs = []
    for word, limits in (("under", under), ("over", over)):
        for t in limits:
            hit = F.when((v < t) if word == "under" else (v > t), v)
            some = F.count(v) > 0
            aggs.append(F.when(some, F.count(hit)).alias(f"{value}_n_{word}_{t}"))
            aggs.append(F.when(some, F.coalesce(F.avg(hit), F.lit(float(t)))).alias(f"{value}_mean_{word}_{t}"))
    return df.groupBy(*keys).agg(*aggs)


def range_share(df: DataFrame, keys: Sequence[str], value: str, time: str, latest: float, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Share of the positive values up to a time limit that lie in [low, high), 0 if none."""
    v = F.when((F.col(value) > 0) & (F.col(time) <= latest), F.col(value))
    shares = {
        n: numbers.safe_fraction(F.count(F.when((v >= low) & (v < high), 1)), F.count(v)) for n, (low, high) in ranges.items()
    }
    return df.groupBy(*keys).agg(*[s.alias(n) for n, s in shares.items()])


def binned_aggregate(
    df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float], mode: str = "count", closed: str = "left", prefix: str = "bin"
) -> DataFrame:
    """Count, share or mean of the values per fixed bin, one column per bin, plus a missing flag."""
    spot = numbers.binned(F.col(value), edges, closed)
    marked = df.withColumn("_bin", spot)
    aggs = []
    for i in range(len(edges) - 1):
        hit = F.when(F.col("_bin") == i, F.col(value))
        if mode == "count":
            cell = F.count(hit)
        elif mode == "share":
            cell = numbers.safe_fraction(F.count(hit), F.count(value))
        elif mode == "mean":
            cell = F.avg(hit)
        else:
            raise ValueError(f"unknown mode: {mode}")
        aggs.append(cell.alias(f"{prefix}_{i}"))
    missing = (F.count(value) == 0).cast("int").alias(f"{prefix}_missing")
    return marked.groupBy(*keys).agg(*aggs, missing)


def equal_width_cross_tab(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """Cut two numeric columns into equal ranges (right-closed); count and share per cell."""
    bounded_by = attach(
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [],
        {"_a0": F.min(a), "_a1": F.max(a), "_b0": F.min(b), "_b1": F.max(b)},
    )

    def cell(c: str, low: str, high: str) -> Column:
        spot = F.ceil((F.col(c) - F.col(low)) / ((F.col(high) - F.col(low)) / bins))
        return F.greatest(F.least(spot, F.lit(bins)), F.lit(1)).cast("int")

    counts = bounded_by.groupBy(cell(a, "_a0", "_a1").alias(f"{a}_bin"), cell(b, "_b0", "_b1").alias(f"{b}_bin")).agg(F.count(F.lit(1)).alias("n"))
    return attach(counts, [], {"_all": F.sum("n")}).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def mode_per_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of each column per group (smallest on ties, as text)."""
    cells = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    long = cells.unpivot(list(keys), list(columns), "_column", "_value")
    counts = long.groupBy(*keys, "_column", "_value").agg(F.count(F.lit(1)).alias("_n"))
    # null loses against any value, whatever its count
    weight = F.when(F.col("_value").isNull(), F.lit(-1)).otherwise(F.col("_n"))
    best = top_rows(counts.withColumn("_w", weight), [*keys, "_column"], ["-_w", "_value"])
    return best.groupBy(*keys).pivot("_column", list(columns)).agg(F.first("_value"))


def upper_median_row(df: DataFrame, keys: Sequence[str], value: str, tie_break: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Of the rows of a group, the one at sorted position floor(n / 2) (0-based); ``rows`` is their number, if it is known."""
    order = [value, *tie_break]
    dealt = spread(df, keys, order, rows) if keys else df
    ranked = attach(numbered(dealt, keys, order, "_no"), keys, {"_n": F.count(F.lit(1))})
    return ranked.where(F.col("_no") == F.floor(F.col("_n") / 2) + 1).drop("_no", "_n")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value with the highest count and that count, per group or over the table."""
    return most_common(df, keys, value)


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Value with the longest consecutive run; the first run wins ties."""
    base = df.where(F.col(value).isNotNull())
    marked = bounded(base, keys, order, 1, 0, {"_prev": lambda w: F.lag(value).over(w), "_first": lambda w: F.row_number().over(w) == 1})
    changed = F.when(F.col("_prev").eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = running(marked.withColumn("_new", changed), keys, order, {"_run": ("sum", F.col("_new"))})
    lengths = runs.groupBy(*keys, "_run", value).agg(F.count(F.lit(1)).alias("length"))
    return top_rows(lengths, keys, ["-length", "_run"]).drop("_run")


def group_describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles, max and total per group."""
    v = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("total")
    )
    return join_on_keys(stats, quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), keys)


def weighted_histogram(df: DataFrame, value: str, weight: str, edges: Sequence[float], integrate: bool = True) -> DataFrame:
    """Per bin: weighted share, density (share, or share / width) and count = share * total weight."""
    spot = numbers.binned(F.col(value), edges, "right")
    inside = df.select(spot.alias("bin"), F.col(weight).alias("_w"), F.col(value).isNotNull().alias("_known"))
    sums = inside.where("_known").groupBy("bin").agg(F.sum("_w").alias("_w"))
    totals = df.agg(F.sum(weight).alias("_total")).scalar()
    with_all = attach(sums.where("bin IS NOT NULL"), [], {"_all": F.sum("_w")})
    share = F.col("_w") / F.col("_all")
    widths = F.get(F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])]), F.col("bin"))
    density = share if integrate else share / widths
    return with_all.select("bin", share.alias("share"), density.alias("density"), (share * totals).alias("count"))


def weighted_total(df: DataFrame, weight: str, keep: Column | None = None) -> DataFrame:
    """Total weight overall and in a sub-population."""
    inside = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    return df.agg(F.sum(weight).alias("total"), F.coalesce(F.sum(F.when(inside, F.col(weight))), F.lit(0.0)).alias("subset_total"))


#: Ranks of so many values at most are broadcast.
FEW_VALUES = 100_000


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson", min_filled: float = 0.5) -> DataFrame:
    """(a, b, correlation) over pairwise complete rows, for columns filled above a share.

    Undefined correlations are 0. Spearman ranks are taken per pair of columns, after
    dropping the rows in which either value is missing; columns without a missing value
    have the same ranks in every pair, so they are ranked once.
    """
    facts = [F.struct(F.count(f"`{c}`").alias("n"), F.avg(F.col(f"`{c}`").cast("double")).alias("mean")).alias(c) for c in columns]
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *facts).first()
    rows = filled["_rows"]
    used = [c for c in columns if rows and filled[c]["n"] / rows > min_filled]
    numbers_of = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in used])
    if method == "pearson":
        means = {c: filled[c]["mean"] for c in used}
        return _correlations(numbers_of, {c: F.col(f"`{c}`") - F.lit(means[c]) for c in used}, list(itertools.combinations(used, 2)))
    whole = [c for c in used if filled[c]["n"] == rows]
    ranked = _ranked(numbers_of, whole) if len(whole) > 1 else numbers_of
    out = _correlations(ranked, {c: F.col(f"`_rank_{c}`") - F.lit((rows + 1) / 2) for c in whole}, list(itertools.combinations(whole, 2)))
    pairs = [p for p in itertools.combinations(used, 2) if not set(p) <= set(whole)]
    return out.unionByName(_pairwise_rank_correlations(numbers_of, pairs)) if pairs else out


def _ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_rank_<column>``, the average rank of each value; values are counted and ranked once for all columns.

    Rows go to the ranks of a column of many values; ranks of few values come to the rows, which would
    otherwise meet in as few tasks as there are values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    counts = settle(df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    upto = running(counts, ["column"], ["value"], {"_upto": ("sum", F.col("n"))})
    ranks = settle(upto.select("column", "value", (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank")), "ranks")
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.max("n").alias("hot")).collect()}
    out = df
    for c in columns:
        mine = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("avg_rank").alias(f"_rank_{c}"))
        if sizes[c]["values"] <= FEW_VALUES:
            out = join_on_keys(out, F.broadcast(mine), [c])
        else:
            out = (lookup if sizes[c]["hot"] > rows_per_slice(df) else join_on_keys)(out, mine, [c])
    return out


def _correlations(df: DataFrame, centred: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, correlation) from one pass that adds up products of all columns block by block.

    Missing values count as zeros in the products, and products with the masks say over which
    rows each pair was summed. What leaves the tasks has one row for each two columns.
    """
    names = list(centred)
    kinds = "a int, b int, n double, sx double, sy double, sxy double, sxx double, syy double"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(names), len(names)))
        for batch in batches:
            known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.float64)
            x = np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            for k, (left, right) in enumerate(((known, known), (x, known), (known, x), (x, x), (x * x, known), (known, x * x))):
                # a few columns take no time, but the matrix library would start its threads in every task
                sums[k] += np.einsum("ir,jr->ij", left, right) if len(names) <= 16 else left @ right.T
        a, b = np.triu_indices(len(names), 1)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(s[a, b]) for s in sums]], [k.split()[0] for k in kinds.split(", ")])

    spark = df.sparkSession
    schema = "a string, b string, correlation double"
    if not pairs:
        return spark.createDataFrame([], schema)
    parts = df.select(*[c.alias(n) for n, c in centred.items()]).mapInArrow(products, kinds)
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    bottom = F.sqrt(n * F.col("sxx") - sx * sx) * F.sqrt(n * F.col("syy") - sy * sy)
    r = F.try_divide(n * F.col("sxy") - sx * sy, bottom)
    word = F.array(*[F.lit(x) for x in names])
    return sums.select(F.get(word, F.col("a")).alias("a"), F.get(word, F.col("b")).alias("b"), F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("correlation"))


def _pairwise_rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlations over the rows in which both columns of a pair have a value."""
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])
    long = df.select(F.inline(both)).where("x IS NOT NULL AND y IS NOT NULL")
    weighted = settle(long.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("w")), "cells")
    for side in ("x", "y"):
        counts = weighted.groupBy("a", "b", side).agg(F.sum("w").alias("_n"))
        upto = running(counts, ["a", "b"], [side], {"_upto": ("sum", F.col("_n"))})
        rank = (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"r{side}")
        ranks = settle(upto.select("a", "b", side, rank), "ranks")
        few = ranks.count() <= FEW_VALUES  # as above
        found = join_on_keys(weighted, F.broadcast(ranks), ["a", "b", side]) if few else lookup(weighted, ranks, ["a", "b", side])
        weighted = same_rows(found, weighted)
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    sums = weighted.groupBy("a", "b").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    bottom = F.sqrt(n * F.col("sxx") - sx * sx) * F.sqrt(n * F.col("syy") - sy * sy)
    r = F.try_divide(n * F.col("sxy") - sx * sy, bottom)
    return sums.select("a", "b", F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("correlation"))


def geo_center(df: DataFrame, keys: Sequence[str], lat: str, lon: str, values: Sequence[str]) -> DataFrame:
    """Median position and mean value per group and variable, value scaled to a 3-16 size."""
    cells = df.select(*keys, lat, lon, *[F.col(v).cast("double").alias(v) for v in values])
    long = cells.unpivot([*keys, lat, lon], list(values), "variable", "value")
    group = [*keys, "variable"]
    means = long.groupBy(*group).agg(F.avg("value").alias("value")).where("value IS NOT NULL")
    for name, c in (("lat", lat), ("lon", lon)):
        means = join_on_keys(means, quantiles(long, group, c, {f"center_{name}": 0.5}), group)
    sized = attach(means, ["variable"], {"_lo": F.min("value"), "_hi": F.max("value")})
    size = 3 + 13 * F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return sized.withColumn("size", size).drop("_lo", "_hi")


def missing_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, nulls, share) per column."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("nulls")) for c in columns])
    out = counts.select(*keys, "_rows", F.inline(cells))
    return out.withColumn("share", F.col("nulls") / F.col("_rows")).drop("_rows")


def response_standardise(df: DataFrame, kind: str, first: str, second: str, name: str = "response") -> DataFrame:
    """z-score within type of the first measure, else the second; both missing is an error."""
    stats = {f"_{f}_{c}": fn(c) for c in (first, second) for f, fn in (("m", F.avg), ("s", F.stddev_samp))}
    out = attach(df, [kind], stats)

    def z(c: str) -> Column:
        return F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))

    value = (
        F.when(F.col(first).isNotNull(), z(first))
        .when(F.col(second).isNotNull(), z(second))
        .otherwise(F.raise_error(F.lit("both measures are missing")).cast("double"))
    )
    return out.withColumn(name, value).drop(*stats)


def summary_long(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """(variable, mean, sd, min, max) rounded."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = cells.unpivot([], list(columns), "variable", "value")
    got = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return got.select("variable", *[F.round(c, digits).alias(c) for c in ("mean", "sd", "min", "max")])


def quantile_interval(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, low, middle, high): the 2.5, 50 and 97.5 percent points."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = cells.unpivot([], list(columns), "variable", "value")
    return quantiles(long, ["variable"], "value", {"low": 0.025, "middle": 0.5, "high": 0.975})


def normal_gamma_posterior(df: DataFrame, keys: Sequence[str], value: str, prior: DataFrame, prior_value: str) -> DataFrame:
    """Posterior (M, L, A, B) per group with an empirical prior of weight one."""
    base = prior.agg(F.struct(F.avg(prior_value).alias("m"), F.var_pop(prior_value).alias("b")).alias("p")).scalar()
    got = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_x"), F.var_pop(value).alias("_v")).withColumn("_p", base)
    n, x, m0, b0 = F.col("_n"), F.col("_x"), F.col("_p.m"), F.col("_p.b")
    return got.select(
        *keys,
        ((m0 + n * x) / (1 + n)).alias("M"),
        (1 + n).cast("double").alias("L"),
        (1 + n / 2).alias("A"),
        (b0 + 0.5 * n * F.col("_v") + n * (x - m0) * (x - m0) / (2 * (1 + n))).alias("B"),
    )


def dirichlet_posterior(df: DataFrame, category: str, alpha: Mapping[str, float] | float) -> DataFrame:
    """(category, alpha): counts plus the prior concentration."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(alpha, Mapping):
        prior = F.lit(0.0)
        for k, a in alpha.items():
            prior = F.when(F.col(category) == k, F.lit(float(a))).otherwise(prior)
    else:
        prior = F.lit(float(alpha))
    return counts.select(category, (F.col("_n") + prior).alias("alpha"))


def hierarchy_rollup(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Value per node of a category tree (nulls below the node's level) and its share of the parent."""
    nodes = df.rollup(*levels).agg(F.sum(value).alias("value"), F.grouping_id().alias("_g"))
    nodes = nodes.withColumn("depth", (len(levels) - F.bit_count("_g")).cast("int")).drop("_g")

    def path(shown: Column) -> Column:
        names = [F.when(shown > i, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for i, c in enumerate(levels)]
        return F.to_json(F.array(*names))

    parents = nodes.select(path(F.col("depth")).alias("_path"), F.col("depth").alias("_depth"), F.col("value").alias("_whole"))
    nodes = nodes.withColumns({"_path": path(F.col("depth") - 1), "_depth": F.col("depth") - 1})
    joined = nodes.join(parents, ["_path", "_depth"], "left")
    return joined.select(*levels, "depth", "value", F.try_divide("value", "_whole").alias("share"))
