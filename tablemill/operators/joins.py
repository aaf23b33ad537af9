"""Joins."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import swap_columns
from tablemill.operators.checks import unique_rows
from tablemill.operators.nearest import nearest_row  # noqa: F401  (one of the joins)
from tablemill.skew import running


def inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def full(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "full")


def left_enrich(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Left join of attributes; a repeated right key is an error."""
    renamed = right.select(*[F.col(r).alias(k) for k, r in zip(left_keys, right_keys)], *[c for c in right.columns if c not in right_keys])
    return left.join(unique_rows(renamed, list(left_keys)), list(left_keys), "left")


def align_tables(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full alignment of several wide tables on shared unique keys, columns ``<table>_<column>``.

    One union and one grouping, so any number of tables costs a single shuffle.
    """
    parts = [
        df.select(*keys, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in df.columns if c not in keys]) for name, df in tables.items()
    ]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(
        *[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in stacked.columns if c not in keys]
    )


def exclusion_join(scores: DataFrame, exclusions: DataFrame, key: str, week: str, report_week: int) -> DataFrame:
    """Rows without an exclusion, or whose exclusion week - 1 lies after the report week."""
    marked = exclusions.select(key, F.col(week).alias("_week"), F.lit(True).alias("_listed"))
    joined = scores.join(marked, key, "left")
    late = F.col("_week").isNotNull() & (F.col("_week") - 1 > report_week)
    return joined.where(F.col("_listed").isNull() | late).drop("_week", "_listed").select(*scores.columns)


def members(df: DataFrame, other: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among the keys of another table."""
    return df.join(other, list(keys), "left_anti" if negate else "left_semi")


def paired_mentions(
    df: DataFrame, actor: str, target: str, weight: str, first: Sequence, second: Sequence, distinct: bool = False
) -> DataFrame:
    """(actor, target_a, target_b, pairs, weight): cross product of two target lists within an actor.

    Repeated mentions are counted before the join, so an actor yields at most
    len(first) * len(second) rows however often it mentions a target; ``pairs`` is the
    number of row pairs and ``weight`` the sum of the first row's weight over them. With
    ``distinct`` every mention counts once.
    """
    used = df.where(F.col(target).isin(list({*first, *second})))
    if distinct:
        used = used.groupBy(actor, target).agg(F.max(weight).alias(weight))
    counted = used.groupBy(actor, target).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    a = counted.where(F.col(target).isin(list(first))).select(actor, F.col(target).alias("target_a"), F.col("n").alias("na"), "w")
    b = counted.where(F.col(target).isin(list(second))).select(actor, F.col(target).alias("target_b"), F.col("n").alias("nb"))
    joined = a.join(b, actor)
    return joined.select(
        actor, "target_a", "target_b", (F.col("na") * F.col("nb")).alias("pairs"), (F.col("w") * F.col("nb")).alias("weight")
    )


def list_product(df: DataFrame, column: str, values: Sequence, name: str, distinct: bool = True) -> DataFrame:
    """Every value of a column paired with every item of a given list."""
    left = df.select(column).distinct() if distinct else df.select(column)
    return left.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def lookup_with_default(
    df: DataFrame, ranks: DataFrame, keys: Sequence[str], group: Sequence[str], entity: str, value: str
) -> DataFrame:
    """Keyed lookup; a miss gives 1 / number of distinct entities of the row's group."""
    sizes = ranks.groupBy(*group).agg((1.0 / F.countDistinct(entity)).alias("_default"))
    found = df.join(ranks.select(*keys, value), list(keys), "left").join(sizes, list(group), "left")
    return found.withColumn(value, F.coalesce(value, "_default")).drop("_default")


def expanding_totals(
    asks: DataFrame, facts: DataFrame, keys: Sequence[str], time: str, sums: Mapping[str, Column], fill: bool = True
) -> DataFrame:
    """For every row (keys, time) of the asks, fact totals strictly before that time.

    An as-of join by one sort: facts, added up per (keys, time), and asks are put below each
    other and running totals go over both, asks first among equal times, so that an ask takes
    the state the facts before it left. Without ``fill``, a total over no fact is null.
    """
    daily = facts.groupBy(*keys, time).agg(*[v.alias(n) for n, v in sums.items()]).withColumn("_fact", F.lit(1))
    both = asks.select(*keys, time, F.lit(0).alias("_fact")).unionByName(daily, allowMissingColumns=True)
    ran = running(both, keys, [time, "_fact"], {f"_run_{n}": ("sum", F.col(f"`{n}`")) for n in sums})
    total = lambda n: F.coalesce(f"`_run_{n}`", F.lit(0)) if fill else F.col(f"`_run_{n}`")
    return ran.where("_fact = 0").select(*keys, time, *[total(n).alias(n) for n in sums])


def expanding_prior(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str = "prior") -> DataFrame:
    """Mean over the rows of the same group strictly before the row's time; no history, no row."""
    known = F.col(value).isNotNull()
    spine = df.select(*keys, time).distinct()
    sums = {"_sum": F.coalesce(F.sum(value), F.lit(0.0)), "_n": F.count(F.when(known, 1))}
    history = expanding_totals(spine, df, keys, time, sums).where("_n > 0")
    return df.join(history.select(*keys, time, (F.col("_sum") / F.col("_n")).alias(name)), [*keys, time])


def mirror_union(games: DataFrame, team: str, opponent: str) -> DataFrame:
    """The table together with its role-swapped copy."""
    return games.unionByName(swap_columns(games, team, opponent))


def zero_fill_counts(entities: DataFrame, key: str, declared: str, events: DataFrame, event_key: str) -> DataFrame:
    """Event count per entity (0 when none) beside the declared count."""
    counts = events.groupBy(F.col(event_key).alias(key)).agg(F.count(F.lit(1)).alias("event_count"))
    joined = entities.select(key, F.col(declared).alias("declared_count")).join(counts, key, "left")
    joined = joined.withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    return joined.withColumn("agrees", F.col("event_count") == F.col("declared_count"))


def source_preference(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which an entity of an earlier source is dropped from all later ones."""
    out = sources[0]
    for later in sources[1:]:
        fresh = later.join(out.select(key).distinct(), key, "left_anti")
        out = out.unionByName(fresh, allowMissingColumns=True)
    return out


def fill_from_answers(df: DataFrame, answers: DataFrame, key: str, column: str, hidden: str = "hidden") -> DataFrame:
    """Missing or hidden values taken from a key table, present values win; result is double."""
    given = unique_rows(answers.select(key, F.col(column).cast("string").alias("_answer")), [key])
    own = F.when(F.col(column).cast("string") != hidden, F.col(column).cast("string"))
    joined = df.join(given, key, "left")
    return joined.withColumn(column, F.coalesce(own, F.col("_answer")).try_cast("double")).drop("_answer").select(*df.columns)


def value_conflicts(a: DataFrame, b: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, feature, a, b, difference) wherever two sources differ."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cells = df.select(key, *[F.col(c).cast("double").alias(c) for c in features])
        return cells.unpivot([key], list(features), "feature", name).where(F.col(name).isNotNull())

    joined = long(a, "value_a").join(long(b, "value_b"), [key, "feature"])
    return joined.withColumn("difference", F.abs(F.col("value_a") - F.col("value_b"))).where("difference > 0")


def map_codes(df: DataFrame, column: str, overrides: Mapping[str, str], name: str = "code") -> DataFrame:
    """Explicit overrides, else the first three letters in upper case."""
    code = F.upper(F.substring(column, 1, 3))
    for source, target in overrides.items():
        code = F.when(F.col(column) == source, target).otherwise(code)
    return df.withColumn(name, code)


def unmatched_codes(left: DataFrame, right: DataFrame, code: str) -> DataFrame:
    """(code, side) present on one side only."""
    a, b = left.select(code).distinct(), right.select(code).distinct()
    only_left = a.join(b, code, "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(b.join(a, code, "left_anti").withColumn("side", F.lit("right")))


def cell_names(stats: DataFrame, cell: Sequence[str] = ("pos", "metric")) -> list[tuple[str, ...]]:
    """The statistics a table holds, as many as its sources have columns."""
    return sorted(tuple(r) for r in stats.select(*cell).distinct().collect())


def past_averages(
    asks: DataFrame, stats: DataFrame, keys: Sequence[str], cells: Sequence[tuple[str, ...]], cell: Sequence[str] = ("pos", "metric"), weights: Sequence[str] = ()
) -> DataFrame:
    """(keys, date, games, one column per cell): average per game before the date of every ask with past games.

    ``stats`` holds (date, keys, game, cell columns, value); a game counts when it has any row.
    Each weight column adds ``<cell>@<weight>``, the average of value * weight. The state of
    all cells is carried along one sort of facts and asks by the keys; a cell without a past
    value is null.
    """
    name, value = F.concat_ws(":", *cell), F.col("value")
    sums = {"games": F.size(F.collect_set("game")).cast("long")}  # the games of one date
    for c in map(":".join, cells):
        sums[c] = F.sum(F.when(name == c, value))
        sums |= {f"{c}@{w}": F.sum(F.when(name == c, value * F.col(w))) for w in weights}
    states = expanding_totals(asks, stats, keys, "date", sums, fill=False).where("games > 0")
    return states.select(*keys, "date", "games", *[(F.col(f"`{n}`") / F.col("games")).alias(n) for n in sums if n != "games"])


def team_history(games: DataFrame, team_stats: DataFrame, label: str) -> DataFrame:
    """Per (date, team, pos, metric): average per past game of a team's recorded totals.

    ``games`` holds (date, team); ``team_stats`` holds (date, team, game, pos, metric,
    value). A past game counts when it has any row. Dates are strictly before. States are
    wide until the end, so no row of a date and a cell is shuffled.
    """
    names = cell_names(team_stats)
    states = past_averages(games.select("date", "team").distinct(), team_stats, ["team"], names)
    cells = [F.struct(F.lit(p).alias("pos"), F.lit(f"{m}:{label}").alias("metric"), F.col(f"`{p}:{m}`").alias("value")) for p, m in names]
    if not cells:
        return states.select("date", "team", *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "string"), ("metric", "string"), ("value", "double"))]).limit(0)
    return states.select("date", "team", F.inline(F.array(*cells))).where("value IS NOT NULL")


def second_degree(games: DataFrame, team_stats: DataFrame) -> DataFrame:
    """What a team's past opponents recorded against it, as that team's own history.

    Swapping the roles of the recorded rows turns "recorded by the opponents of T against
    T" into rows of T, so all games share one running total instead of a search per game.
    """
    return team_history(games, swap_columns(team_stats, "team", "opponent"), "2nd")


def team_states(games: DataFrame, team_stats: DataFrame, cells: Sequence[tuple[str, str]]) -> DataFrame:
    """(date, team, ``<pos>:<metric>:1st``, ``...:2nd``): a team's own past averages and those of its opponents against it."""
    asks = games.select("date", "team").distinct()
    sides = []
    for label, rows in (("1st", team_stats), ("2nd", swap_columns(team_stats, "team", "opponent"))):
        states = past_averages(asks, rows, ["team"], cells)
        sides.append(states.select("date", "team", *[F.col(f"`{c}`").alias(f"{c}:{label}") for c in map(":".join, cells)]))
    return sides[0].join(sides[1], ["date", "team"], "full")


def seats(games: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per game and player on either side: game, date, team, opponent, is_home, player, pos."""
    return games.join(roster, "team").select("game", "date", "team", "opponent", "is_home", "player", "pos")


def game_context(places: DataFrame, teams: DataFrame, players: DataFrame, results: DataFrame) -> DataFrame:
    """Every seat with the past of its team, its opponent and its player and with the game's own result.

    ``teams`` holds (date, team, ...), ``players`` (date, team, player, ...) and ``results``
    (game, team, player, ...); their other columns become ``Team:``, ``Opp:``, ``Player:`` and ``Result:`` columns, null
    where there is nothing. Rows are as wide as a matrix and as many as the seats.
    """
    def named(df: DataFrame, ids: Mapping[str, str], family: str) -> DataFrame:
        return df.select(*[F.col(i).alias(n) for i, n in ids.items()], *[F.col(f"`{c}`").alias(f"{family}:{c}") for c in df.columns if c not in ids])

    out = places.join(named(teams, {"date": "date", "team": "team"}, "Team"), ["date", "team"], "left")
    out = out.join(named(teams, {"date": "date", "team": "opponent"}, "Opp"), ["date", "opponent"], "left")
    for df, family, own in ((players, "Player", ["date", "team", "player"]), (results, "Result", ["game", "team", "player"])):
        out = out.join(named(df, dict(zip(own, own)), family), own, "left")
    return out
