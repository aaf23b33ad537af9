"""Ranking over a matchup graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import swap_columns
from tablemill.operators.joins import expanding_totals
from tablemill.session import settle
from tablemill.skew import attach, hot_rows, join_on_keys, slicing, top_rows

# iterations between two looks at the distance
STEPS_PER_CHECK = 4


def matchup_scores(
    data: DataFrame, dates: Sequence, weights: Mapping[str, float], seasons: int = 3, standardize: bool = True
) -> DataFrame:
    """(date, team, opponent, score) as of each date, from rows strictly before it.

    ``data`` holds (year, date, team, opponent, <stats>). Stats are standardised over the
    whole history before the date (population sd), weighted and added; the score is the
    mean per pair over the current and the last ``seasons`` years. A date without such
    history scores its own games 0. The mean of standardised values is the standardised
    mean, so running totals per pair and per date replace a pass per date.
    """
    stats = list(weights)
    col = lambda s: F.col(f"`{s}`").cast("double")
    asked = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    daily = data.groupBy("date").agg(*[F.sum(col(s)).alias(f"s{i}") for i, s in enumerate(stats)], *[F.sum(col(s) ** 2).alias(f"q{i}") for i, s in enumerate(stats)], F.count(F.lit(1)).alias("n"))
    names = [f"{t}{i}" for i in range(len(stats)) for t in "sq"] + ["n"]
    spine = data.select(F.lit(0).alias("k")).limit(1).withColumn("date", asked)
    whole = expanding_totals(spine, daily.withColumn("k", F.lit(0)), ["k"], "date", {n: F.sum(n) for n in names}).drop("k")
    pairs = data.select("team", "opponent").distinct().withColumn("date", asked)
    opening = pairs.withColumn("date", F.make_date(F.year("date") - seasons, F.lit(1), F.lit(1)))
    sums = {f"p{i}": F.sum(col(s)) for i, s in enumerate(stats)} | {"m": F.count(F.lit(1))}
    upto = expanding_totals(pairs, data, ["team", "opponent"], "date", sums)
    before = expanding_totals(opening.distinct(), data, ["team", "opponent"], "date", sums)
    before = before.select("team", "opponent", F.year("date").alias("_y"), *[F.col(n).alias(f"_{n}") for n in sums])
    joined = upto.withColumn("_y", F.year("date") - seasons).join(before, ["team", "opponent", "_y"]).join(whole, "date")
    games = F.col("m") - F.col("_m")
    score = F.lit(0.0)
    for i, s in enumerate(stats):
        mean = (F.col(f"p{i}") - F.col(f"_p{i}")) / games
        if standardize:
            centre = F.col(f"s{i}") / F.col("n")
            spread = F.sqrt(F.greatest(F.col(f"q{i}") / F.col("n") - centre * centre, F.lit(0.0)))
            # a constant column keeps its centred value, as a scale of 0 is read as 1
            mean = (mean - centre) / F.when(spread > 1e-12 * F.abs(centre), spread).otherwise(1.0)
        score = score + weights[s] * mean
    scored = joined.where(games > 0).select("date", "team", "opponent", score.alias("score"))
    fresh = data.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    new = fresh.select("date", "team", "opponent").join(scored.select("date").distinct(), "date", "left_anti").withColumn("score", F.lit(0.0))
    return scored.unionByName(new.distinct())


def transition_rows(
    scores: DataFrame, keys: Sequence[str] = (), linear: bool = False, less_is_better: bool = True, damping: float | None = 0.15
) -> DataFrame:
    """Edges (keys, team, opponent, p, weight, base) of the row-normalised transition matrix.

    p is the normalised score within the team (linear share or softmax of z-scores; equal
    scores give a uniform row). Every cell of the matrix is d + (1 - d) * p divided by the
    row's total; ``base`` is that value for the pairs without an edge, so the full square
    is never built. ``damping`` may also be a column of the scores when None is passed.
    """
    keys = list(keys)
    group = [*keys, "team"]
    d = F.col("damping") if damping is None else F.lit(float(damping))
    v = F.col("score")
    out = attach(scores, group, {"_lo": F.min(v), "_hi": F.max(v), "_m": F.avg(v), "_s": F.stddev_pop(v), "_sum": F.sum(v), "_n": F.count(v)})
    if linear:
        width = F.col("_hi") - F.col("_lo")
        share = F.try_divide((v - F.col("_lo")) / width, (F.col("_sum") - F.col("_n") * F.col("_lo")) / width)
        p = 1 - share if less_is_better else share
    else:
        z = (v - F.col("_m")) / F.col("_s")
        p = F.exp(-z if less_is_better else z)
    out = out.withColumn("p", F.when(F.col("_lo") == F.col("_hi"), F.lit(None).cast("double")).otherwise(p))
    out = attach(out, group, {"_e": F.sum("p")})
    uniform = F.col("_lo") == F.col("_hi")
    out = out.withColumn("p", F.when(uniform, 1.0 / F.col("_n")).otherwise(F.col("p") if linear else F.col("p") / F.col("_e")))
    out = attach(out, group, {"_row": F.sum("p")})
    everyone = scores.select(*keys, "team").unionByName(scores.select(*keys, F.col("opponent").alias("team")))
    teams = everyone.groupBy(*keys).agg(F.countDistinct("team").alias("_teams"))
    out = join_on_keys(out, teams, keys) if keys else out.withColumn("_teams", teams.scalar())
    total = d * F.col("_teams") + (1 - d) * F.col("_row")
    out = out.withColumns({"weight": (d + (1 - d) * F.col("p")) / total, "base": d / total})
    return out.select(*keys, "team", "opponent", "p", "weight", "base")


def smallest_component(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, team) of the smallest strongly connected component (smallest member on ties).

    Each round every open vertex takes the largest name that reaches it; the vertices that
    reach their own root back form one component per root and leave the graph.
    """
    keys = list(keys)
    links = settle(edges.where(F.col("weight") > 0).select(*keys, F.col("team").alias("a"), F.col("opponent").alias("b")).distinct())
    open_ = settle(links.select(*keys, F.col("a").alias("v")).unionByName(links.select(*keys, F.col("b").alias("v"))).distinct())
    found = None
    while not open_.isEmpty():
        alive = settle(links.join(open_.withColumnRenamed("v", "a"), [*keys, "a"], "left_semi").join(open_.withColumnRenamed("v", "b"), [*keys, "b"], "left_semi"))
        colour = _spread(open_.withColumn("c", F.col("v")), alive, keys)
        inside = alive.join(colour.select(*keys, F.col("v").alias("a"), F.col("c").alias("ca")), [*keys, "a"])
        inside = inside.join(colour.select(*keys, F.col("v").alias("b"), F.col("c").alias("cb")), [*keys, "b"]).where("ca = cb")
        back = settle(inside.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        reach = _spread(colour.select(*keys, "v", F.when(F.col("v") == F.col("c"), F.col("c")).alias("c")), back, keys)
        done = settle(reach.where("c IS NOT NULL").join(colour.withColumnRenamed("c", "root"), [*keys, "v"]).where("c = root").select(*keys, "v", "root"))
        found = done if found is None else found.unionByName(done)
        open_ = settle(open_.join(done, [*keys, "v"], "left_anti"))
    sizes = found.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"))
    best = top_rows(sizes, keys, ["n", "first"]).select(*keys, "root")
    return found.join(best, [*keys, "root"], "left_semi").select(*keys, F.col("v").alias("team"))


def _spread(labels: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Largest label that reaches each vertex along the links (null labels carry nothing)."""
    labels = settle(labels)
    while True:
        sent = links.join(labels.select(*keys, F.col("v").alias("a"), "c"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("v")).agg(F.max("c").alias("_c"))
        fresh = labels.join(sent, [*keys, "v"], "left").select(*keys, "v", F.greatest("c", "_c").alias("_new"), "c")
        fresh = settle(fresh)
        changed = not fresh.where(~F.col("_new").eqNullSafe(F.col("c"))).isEmpty()
        labels = fresh.select(*keys, "v", F.col("_new").alias("c"))
        if not changed:
            return labels


def stationary_rank(
    edges: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-10, max_iterations: int = 400, undamped: bool = False
) -> DataFrame:
    """(keys, team, rank): stationary distribution of the transition rows.

    Power iteration on the edge list; ``base`` carries the weight of all missing pairs. A
    team without a row of its own passes its mass on evenly. A chain without damping may
    fall apart: then only the smallest strongly connected component gets mass, and the
    iteration is made lazy so that it also settles on periodic chains.

    Graphs that are no hot keys are iterated whole, each in one task; larger ones round by
    round over tables. Ranks that do not settle are an error either way.
    """
    keys = list(keys)
    if undamped:
        kept = settle(smallest_component(edges, keys), "component")
        edges = edges.join(kept, [*keys, "team"], "left_semi").join(kept.withColumnRenamed("team", "opponent"), [*keys, "opponent"], "left_semi")
        edges = attach(edges, [*keys, "team"], {"_row": F.sum("weight")}).withColumn("weight", F.col("weight") / F.col("_row")).drop("_row")
        teams = kept
    else:
        teams = edges.select(*keys, F.col("opponent").alias("team")).unionByName(edges.select(*keys, "team")).distinct()
    links = settle(edges.select(*keys, "team", "opponent", (F.col("weight") - F.col("base")).alias("extra"), "base"))
    if not keys:
        links, teams = links.withColumn("_graph", F.lit(0)), teams.withColumn("_graph", F.lit(0))
    group = keys or ["_graph"]
    cuts = slicing(links, group)
    if cuts is None:
        return _whole_graphs(links, teams, group, tolerance, max_iterations, undamped).select(*keys, "team", "rank")
    small, large = ((hot_rows(links, group, cuts, hot), hot_rows(teams, group, cuts, hot)) for hot in (False, True))
    out = _by_rounds(*large, group, tolerance, max_iterations, undamped)
    return out.unionByName(_whole_graphs(*small, group, tolerance, max_iterations, undamped)).select(*keys, "team", "rank")


def _whole_graphs(links: DataFrame, teams: DataFrame, keys: list[str], tolerance: float, rounds: int, lazy: bool) -> DataFrame:
    """Each graph iterated in memory; a graph has no more links than a slice has rows."""
    out = T.StructType([*[links.schema[k] for k in keys], links.schema["team"], T.StructField("rank", T.DoubleType())])
    rows = links.select(*keys, "team", "opponent", "extra", "base").unionByName(teams.select(*keys, "team"), allowMissingColumns=True)

    def iterate(pdf: pd.DataFrame) -> pd.DataFrame:
        edge = pdf["opponent"].notna().to_numpy()
        names, code = np.unique(pdf["team"].to_numpy(), return_inverse=True)
        a, b = code[edge], np.searchsorted(names, pdf["opponent"].to_numpy()[edge])
        extra, n = pdf["extra"].to_numpy()[edge].astype(float), len(names)
        base = np.full(n, 1.0 / n)  # a team without a row passes its mass on evenly
        base[a] = pdf["base"].to_numpy()[edge].astype(float)
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            fresh = np.bincount(b, extra * rank[a], n) + (rank * base).sum()
            fresh = (rank + fresh) / 2 if lazy else fresh
            moved, rank = np.abs(fresh - rank).sum(), fresh
            if moved < tolerance:
                return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "team": names, "rank": rank})
        raise ArithmeticError(f"the ranks have not settled to {tolerance} after {rounds} rounds")

    return rows.groupBy(*keys).applyInPandas(iterate, out)


def _by_rounds(links: DataFrame, teams: DataFrame, keys: list[str], tolerance: float, rounds: int, lazy: bool) -> DataFrame:
    """One stored table of ranks for each round."""
    links = settle(links, "links")
    bases = links.groupBy(*keys, "team").agg(F.max("base").alias("base"))
    state = attach(teams, keys, {"_n": F.count(F.lit(1))}).select(*keys, "team", (1.0 / F.col("_n")).alias("rank"))
    state = settle(join_on_keys(state, bases, [*keys, "team"]).withColumn("base", F.coalesce("base", "rank")))

    def step(now: DataFrame) -> DataFrame:
        sent = links.drop("base").join(now.select(*keys, "team", "rank"), [*keys, "team"])
        got = sent.groupBy(*keys, F.col("opponent").alias("team")).agg(F.sum(F.col("rank") * F.col("extra")).alias("_got"))
        spread = attach(now, keys, {"_even": F.sum(F.col("rank") * F.col("base"))}, pre_grouped=True)
        joined = join_on_keys(spread, got, [*keys, "team"])
        fresh = F.coalesce("_got", F.lit(0.0)) + F.col("_even")
        return joined.withColumn("rank", (F.col("rank") + fresh) / 2 if lazy else fresh).select(*keys, "team", "rank", "base")

    for i in range(1, rounds + 1):
        fresh = settle(step(state), "ranks")
        if i % STEPS_PER_CHECK == 0:
            moved = state.join(fresh.select(*keys, "team", F.col("rank").alias("_new")), [*keys, "team"])
            distance = moved.groupBy(*keys).agg(F.sum(F.abs(F.col("rank") - F.col("_new"))).alias("d")).agg(F.max("d")).first()[0]
            if distance is None or distance < tolerance:
                return fresh.select(*keys, "team", "rank")
        state = fresh
    raise ArithmeticError(f"the ranks have not settled to {tolerance} after {rounds} rounds")


def simple_strength(data: DataFrame, stat: str, damping: float) -> DataFrame:
    """(opponent, strength): inverted min-max of the mean stat per opponent, as damped share."""
    means = data.groupBy("opponent").agg(F.avg(F.col(f"`{stat}`")).alias("_v"))
    means = attach(means, [], {"_lo": F.min("_v"), "_hi": F.max("_v"), "_n": F.count(F.lit(1))})
    inverted = means.withColumn("_i", 1 - (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    total = attach(inverted, [], {"_sum": F.sum("_i")})
    return total.select("opponent", (damping / F.col("_n") + (1 - damping) * F.col("_i") / F.col("_sum")).alias("strength"))


def rank_timeseries(
    data: DataFrame, dates: Sequence, profiles: Mapping[str, Mapping[str, float]], dampings: Sequence[float], seasons: int = 3
) -> DataFrame:
    """(type, direction, damping, date, team, rank) for every combination, in one iteration.

    Direction 'defense' follows the table as it is with less counting as better, 'offense'
    its mirror with more counting as better. Missing or zero ranks become 1 / n.
    """
    scored = None
    for name, weights in profiles.items():
        for direction, sign in (("defense", 1.0), ("offense", -1.0)):
            rows = data if direction == "defense" else swap_columns(data, "team", "opponent")
            part = matchup_scores(rows, dates, weights, seasons).withColumn("score", F.col("score") * sign)
            part = part.withColumns({"type": F.lit(name), "direction": F.lit(direction)})
            scored = part if scored is None else scored.unionByName(part)
    keys = ["type", "direction", "damping", "date"]
    factor = F.explode(F.array(*[F.lit(float(d)) for d in dampings]))
    edges = settle(transition_rows(settle(scored, "scores").withColumn("damping", factor), keys, damping=None), "edges")
    ranks = stationary_rank(edges, keys)
    sized = attach(ranks, keys, {"_n": F.count(F.lit(1))})
    return sized.withColumn("rank", F.when(F.coalesce("rank", F.lit(0.0)) == 0, 1.0 / F.col("_n")).otherwise(F.col("rank"))).drop("_n")
