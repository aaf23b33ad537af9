"""The test tables read as matchups: who sold to whom, month by month.

A game is a (month, pair of nations); a team's players are the brands its suppliers sold.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.registry.base import table
from tablemill.session import settle

# team_rows: one row per sold line between two different nations
LINES_SQL = """lines AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS date, s_nationkey AS team, c_nationkey AS opponent, p_brand AS player,
         CASE WHEN p_size <= 25 THEN 'S' ELSE 'L' END AS pos, l_quantity AS q, l_extendedprice AS x, l_discount AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE s_nationkey <> c_nationkey)"""

STATS_SQL = (
    LINES_SQL
    + """,
wide AS (SELECT date, team, opponent, player, pos, sum(q) AS yds, count(*) AS att, max(x) AS lg, avg(x) AS ypa FROM lines GROUP BY ALL),
stats AS (
  SELECT date, team, opponent, strftime(date, '%Y-%m') || ':' || least(team, opponent) || ':' || greatest(team, opponent) AS game,
         player, pos, metric, value
  FROM (SELECT date, team, opponent, player, pos, 'passing:Yds' AS metric, CAST(yds AS DOUBLE) AS value FROM wide
        UNION ALL SELECT date, team, opponent, player, pos, 'passing:Att', CAST(att AS DOUBLE) FROM wide
        UNION ALL SELECT date, team, opponent, player, pos, 'passing:Lg', lg FROM wide
        UNION ALL SELECT date, team, opponent, player, pos, 'passing:YPA', ypa FROM wide))"""
)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    item = item.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    item = item.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    item = item.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return item.where("s_nationkey <> c_nationkey").select(
        F.trunc("o_orderdate", "month").alias("date"),
        F.col("s_nationkey").alias("team"),
        F.col("c_nationkey").alias("opponent"),
        F.col("p_brand").alias("player"),
        F.when(F.col("p_size") <= 25, "S").otherwise("L").alias("pos"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("x"),
        F.col("l_discount").alias("d"),
    )


def wide_stats(spark: SparkSession, sf: str) -> DataFrame:
    grouped = lines(spark, sf).groupBy("date", "team", "opponent", "player", "pos")
    wide = grouped.agg(
        F.sum("q").alias("passing:Yds"), F.count("*").cast("double").alias("passing:Att"),
        F.max("x").alias("passing:Lg"), F.avg("x").alias("passing:YPA"),
    )
    low, high = F.least("team", "opponent").cast("string"), F.greatest("team", "opponent").cast("string")
    return wide.withColumn("game", F.concat_ws(":", F.date_format("date", "yyyy-MM"), low, high))


METRICS = ["passing:Yds", "passing:Att", "passing:Lg", "passing:YPA"]

#: One row per (date, team, opponent, game, pos) and metric: players rolled up by each metric's own rule.
TEAMS_SQL = """teams AS (
  SELECT date, team, opponent, strftime(date, '%Y-%m') || ':' || least(team, opponent) || ':' || greatest(team, opponent) AS game, pos, metric, value
  FROM (SELECT date, team, opponent, pos, 'passing:Yds' AS metric, CAST(sum(yds) AS DOUBLE) AS value FROM wide GROUP BY ALL
        UNION ALL SELECT date, team, opponent, pos, 'passing:Att', CAST(sum(att) AS DOUBLE) FROM wide GROUP BY ALL
        UNION ALL SELECT date, team, opponent, pos, 'passing:Lg', max(lg) FROM wide GROUP BY ALL
        UNION ALL SELECT date, team, opponent, pos, 'passing:YPA', sum(ypa * att) / sum(att) FROM wide GROUP BY ALL))"""


def stat_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The statistics as their sources print them, in texts: attempts as ``5/7``, the longest with a ``t`` behind it."""
    text = lambda m: F.col(f"`passing:{m}`").cast("string")
    wide = settle(wide_stats(spark, sf), "wide")
    attempts = F.concat(text("Att"), F.lit("/"), text("Att"))
    return {
        "passing": wide.select(
            "game", "team", "player", "pos", text("Yds").alias("Yds"), attempts.alias("Att"), F.concat(text("Lg"), F.lit("t")).alias("Lg"), text("YPA").alias("YPA")
        )
    }


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """(date, team, opponent, game, player, pos, metric, value)"""
    keys = ["date", "team", "opponent", "game", "player", "pos"]
    return settle(wide_stats(spark, sf), "stats").unpivot(keys, [F.col(f"`{m}`") for m in METRICS], "metric", "value")


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One row per game and side: (game, date, team, opponent, is_home)."""
    sides = settle(lines(spark, sf).select("date", "team", "opponent").distinct(), "sides")
    both = sides.unionByName(sides.select("date", F.col("opponent").alias("team"), F.col("team").alias("opponent"))).distinct()
    low, high = F.least("team", "opponent").cast("string"), F.greatest("team", "opponent").cast("string")
    game = F.concat_ws(":", F.date_format("date", "yyyy-MM"), low, high)
    return both.select(game.alias("game"), "date", "team", "opponent", (F.col("team") < F.col("opponent")).alias("is_home"))


GAMES_SQL = """sides AS (SELECT DISTINCT date, team, opponent FROM lines UNION SELECT DISTINCT date, opponent, team FROM lines),
games AS (SELECT strftime(date, '%Y-%m') || ':' || least(team, opponent) || ':' || greatest(team, opponent) AS game, date, team, opponent,
                 team < opponent AS is_home FROM sides)"""
