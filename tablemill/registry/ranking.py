"""Ranking over the matchup graph of selling and buying nations."""

from pyspark.sql import functions as F

from tablemill.operators import ranking as ops
from tablemill.registry import bindings
from tablemill.registry.base import day_text, query, r6
from tablemill.session import fresh_folder, settle
from tablemill.sources.tables import keyed_upsert

DATES = ["1997-07-01", "1999-01-01", "2001-03-01"]
WEIGHTS = {"yds": 0.7, "att": 0.3}

DATA_SQL = (
    bindings.LINES_SQL
    + """, data AS (SELECT date, year(date) AS year, team, opponent, sum(q) AS yds, count(*)::DOUBLE AS att FROM lines GROUP BY date, team, opponent),
dates AS (SELECT unnest([DATE '1997-07-01', DATE '1999-01-01', DATE '2001-03-01']) AS upto),
whole AS (SELECT upto, avg(yds) AS my, stddev_pop(yds) AS sy, avg(att) AS ma, stddev_pop(att) AS sa FROM dates JOIN data ON date < upto GROUP BY 1),
scores AS (SELECT upto AS date, team, opponent, 0.7::DOUBLE * (avg(yds) - any_value(my)) / any_value(sy) + 0.3::DOUBLE * (avg(att) - any_value(ma)) / any_value(sa) AS score
  FROM whole JOIN data ON date < upto AND year >= year(upto) - 3 GROUP BY upto, team, opponent)"""
)
MATRIX_SQL = """teams AS (SELECT date, count(DISTINCT k) AS n FROM (SELECT date, team AS k FROM scores UNION ALL SELECT date, opponent FROM scores) GROUP BY 1),
soft AS (SELECT date, team, opponent, CASE WHEN stddev_pop(score) OVER w = 0 THEN 1.0 ELSE exp(-(score - avg(score) OVER w) / stddev_pop(score) OVER w) END AS e FROM scores WINDOW w AS (PARTITION BY date, team)),
edges AS (SELECT date, team, opponent, e / sum(e) OVER (PARTITION BY date, team) AS p, n FROM soft JOIN teams USING (date)),
weights AS (SELECT date, team, opponent, p, (0.15::DOUBLE + 0.85::DOUBLE * p) / (0.15::DOUBLE * n + 0.85::DOUBLE) AS weight, 0.15::DOUBLE / (0.15::DOUBLE * n + 0.85::DOUBLE) AS base FROM edges)"""


def matchups(spark, sf):
    rows = bindings.lines(spark, sf).groupBy("date", F.year("date").alias("year"), "team", "opponent")
    return settle(rows.agg(F.sum("q").alias("yds"), F.count("*").cast("double").alias("att")), "matchups")


def scores(spark, sf):
    return settle(ops.matchup_scores(matchups(spark, sf), DATES, WEIGHTS), "scores")


@query("G01_matchup_scores", f"WITH {DATA_SQL} SELECT strftime(date, '%Y-%m-%d') AS day, team, opponent, R6(score) AS score FROM scores")
def _(spark, sf):
    return scores(spark, sf).select(day_text("date").alias("day"), "team", "opponent", r6("score").alias("score"))


@query(
    "G02_transition_rows",
    f"WITH {DATA_SQL}, {MATRIX_SQL} SELECT strftime(date, '%Y-%m-%d') AS day, team, opponent, R6(p) AS p, R6(weight) AS weight, R6(base) AS base FROM weights",
)
def _(spark, sf):
    rows = ops.transition_rows(scores(spark, sf), ["date"])
    return rows.select(day_text("date").alias("day"), "team", "opponent", *[r6(c).alias(c) for c in ("p", "weight", "base")])


@query(
    "G02_transition_rows_linear",
    f"""WITH {DATA_SQL}, s AS (SELECT *, score - min(score) OVER w AS v FROM scores WINDOW w AS (PARTITION BY date, team)),
        p AS (SELECT date, team, opponent, 1 - v / sum(v) OVER (PARTITION BY date, team) AS p FROM s), n AS (SELECT date, count(DISTINCT k) AS n FROM (SELECT date, team AS k FROM scores UNION ALL SELECT date, opponent FROM scores) GROUP BY 1)
        SELECT strftime(date, '%Y-%m-%d') AS day, team, opponent, R6(p) AS p,
               R6((0.3::DOUBLE + 0.7::DOUBLE * p) / (0.3::DOUBLE * n + 0.7::DOUBLE * sum(p) OVER (PARTITION BY date, team))) AS weight FROM p JOIN n USING (date)""",
)
def _(spark, sf):
    rows = ops.transition_rows(scores(spark, sf), ["date"], linear=True, damping=0.3)
    return rows.select(day_text("date").alias("day"), "team", "opponent", r6("p").alias("p"), r6("weight").alias("weight"))


@query(
    "G03_stationary_rank",
    f"""WITH RECURSIVE {DATA_SQL}, {MATRIX_SQL},
        names AS (SELECT DISTINCT date, k AS team FROM (SELECT date, team AS k FROM scores UNION ALL SELECT date, opponent FROM scores)),
        dense AS (SELECT a.date, a.team, b.team AS opponent, coalesce(w.weight, t.base, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.date, a.team)) AS weight FROM names a JOIN names b USING (date) LEFT JOIN (SELECT DISTINCT date, team, base FROM weights) t ON t.date = a.date AND t.team = a.team
                  LEFT JOIN weights w ON w.date = a.date AND w.team = a.team AND w.opponent = b.team),
        walk AS (SELECT 0 AS i, date, team, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS rank FROM names
                 UNION ALL SELECT i + 1, d.date, d.opponent, sum(rank * weight) FROM walk w JOIN dense d ON d.date = w.date AND d.team = w.team WHERE i < 60 GROUP BY i, d.date, d.opponent)
        SELECT strftime(date, '%Y-%m-%d') AS day, team, R6(rank) AS rank FROM walk WHERE i = 60""",
)
def _(spark, sf):
    ranks = ops.stationary_rank(ops.transition_rows(scores(spark, sf), ["date"]), ["date"])
    return ranks.select(day_text("date").alias("day"), "team", r6("rank").alias("rank"))


@query(
    "G03_undamped",
    f"""WITH RECURSIVE {DATA_SQL}, soft AS (SELECT date, team, opponent, CASE WHEN stddev_pop(score) OVER w = 0 THEN 1.0 ELSE exp(-(score - avg(score) OVER w) / stddev_pop(score) OVER w) END AS e FROM scores WINDOW w AS (PARTITION BY date, team)),
        e AS (SELECT date, team, opponent, e / sum(e) OVER (PARTITION BY date, team) AS weight FROM soft),
        reach AS (SELECT date, team, team AS opponent FROM e UNION SELECT date, opponent, opponent FROM e UNION SELECT date, team, opponent FROM e UNION SELECT r.date, r.team, e.opponent FROM reach r JOIN e ON e.date = r.date AND e.team = r.opponent),
        c AS (SELECT a.date, a.team, min(a.opponent) AS root, count(*) AS n FROM reach a JOIN reach b ON b.date = a.date AND b.team = a.opponent AND b.opponent = a.team GROUP BY 1, 2),
        smallest AS (SELECT date, arg_min(root, [n, root]) AS root FROM c GROUP BY 1),
        kept AS (SELECT c.date, team FROM c JOIN smallest USING (date, root)),
        linked AS (SELECT e.date, e.team, e.opponent, weight / sum(weight) OVER (PARTITION BY e.date, e.team) AS weight FROM e JOIN kept k ON k.date = e.date AND k.team = e.team JOIN kept l ON l.date = e.date AND l.team = e.opponent),
        inside AS (SELECT * FROM linked UNION ALL SELECT date, team, team, 1 FROM kept ANTI JOIN linked USING (date, team)),
        walk AS (SELECT 0 AS i, date, team, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS rank FROM kept
                 UNION ALL SELECT i + 1, date, team, sum(rank) FROM (SELECT i, date, team, rank / 2 AS rank FROM walk UNION ALL SELECT i, d.date, d.opponent, rank * weight / 2 FROM walk w JOIN inside d ON d.date = w.date AND d.team = w.team) WHERE i < 120 GROUP BY i, date, team)
        SELECT strftime(date, '%Y-%m-%d') AS day, team, R6(rank) AS rank FROM walk WHERE i = 120""",
)
def _(spark, sf):
    ranks = ops.stationary_rank(ops.transition_rows(scores(spark, sf), ["date"], damping=0.0), ["date"], undamped=True)
    return ranks.select(day_text("date").alias("day"), "team", r6("rank").alias("rank"))


@query(
    "G04_simple_strength",
    f"""WITH {DATA_SQL}, m AS (SELECT opponent, avg(yds) AS v FROM data GROUP BY 1), i AS (SELECT opponent, 1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS i FROM m)
        SELECT opponent, R6(0.2::DOUBLE / count(*) OVER () + 0.8::DOUBLE * i / sum(i) OVER ()) AS strength FROM i""",
)
def _(spark, sf):
    return ops.simple_strength(matchups(spark, sf), "yds", 0.2).select("opponent", r6("strength").alias("strength"))


@query(
    "G05_rank_timeseries",
    f"""WITH RECURSIVE {DATA_SQL.rsplit("whole AS", 1)[0]}both_ways AS (SELECT 'defense' AS direction, 1.0::DOUBLE AS sign, date, year, team, opponent, yds, att FROM data UNION ALL SELECT 'offense', -1, date, year, opponent, team, yds, att FROM data),
        whole AS (SELECT upto, avg(yds) AS my, stddev_pop(yds) AS sy, avg(att) AS ma, stddev_pop(att) AS sa FROM dates JOIN data ON date < upto GROUP BY 1),
        z AS (SELECT direction, sign, upto AS date, team, opponent, (avg(yds) - any_value(my)) / any_value(sy) AS zy, (avg(att) - any_value(ma)) / any_value(sa) AS za
              FROM whole JOIN both_ways ON date < upto AND year >= year(upto) - 3 GROUP BY direction, sign, upto, team, opponent),
        points AS (SELECT 'volume' AS type, direction, date, team, opponent, sign * (0.7::DOUBLE * zy + 0.3::DOUBLE * za) AS score FROM z UNION ALL SELECT 'size', direction, date, team, opponent, sign * zy FROM z),
        soft AS (SELECT *, CASE WHEN stddev_pop(score) OVER w = 0 THEN 1.0 ELSE exp(-(score - avg(score) OVER w) / stddev_pop(score) OVER w) END AS e FROM points WINDOW w AS (PARTITION BY type, direction, date, team)),
        names AS (SELECT DISTINCT type, direction, date, k AS team FROM (SELECT type, direction, date, team AS k FROM points UNION ALL SELECT type, direction, date, opponent FROM points)),
        n AS (SELECT type, direction, date, count(*) AS n FROM names GROUP BY 1, 2, 3),
        w AS (SELECT s.type, s.direction, s.date, damping, team, opponent, e / sum(e) OVER (PARTITION BY s.type, s.direction, s.date, damping, team) AS p, damping * n + 1 - damping AS total
              FROM soft s JOIN n USING (type, direction, date), (VALUES (0.2::DOUBLE), (0.8::DOUBLE)) AS f(damping)),
        rows AS (SELECT DISTINCT type, direction, date, damping, team, damping / total AS base FROM w),
        dense AS (SELECT a.type, a.direction, a.date, f.damping, a.team, b.team AS opponent, coalesce((f.damping + (1 - f.damping) * p) / total, r.base, 1.0::DOUBLE / n) AS weight
                  FROM names a JOIN names b USING (type, direction, date) JOIN n USING (type, direction, date) CROSS JOIN (VALUES (0.2::DOUBLE), (0.8::DOUBLE)) AS f(damping)
                       LEFT JOIN rows r ON r.type = a.type AND r.direction = a.direction AND r.date = a.date AND r.damping = f.damping AND r.team = a.team
                       LEFT JOIN w ON w.type = a.type AND w.direction = a.direction AND w.date = a.date AND w.damping = f.damping AND w.team = a.team AND w.opponent = b.team),
        walk AS (SELECT 0 AS i, type, direction, date, damping, team, 1.0::DOUBLE / n AS rank FROM names JOIN n USING (type, direction, date), (VALUES (0.2::DOUBLE), (0.8::DOUBLE)) AS f(damping)
                 UNION ALL SELECT i + 1, d.type, d.direction, d.date, d.damping, d.opponent, sum(rank * weight) FROM walk v JOIN dense d ON d.type = v.type AND d.direction = v.direction AND d.date = v.date AND d.damping = v.damping AND d.team = v.team
                           WHERE i < 60 GROUP BY i, d.type, d.direction, d.date, d.damping, d.opponent)
        SELECT type, direction, damping, strftime(date, '%Y-%m-%d') AS date, team, R6(rank) AS rank FROM walk WHERE i = 60""",
)
def _(spark, sf):
    profiles = {"volume": {"yds": 0.7, "att": 0.3}, "size": {"yds": 1.0}}
    ranks = ops.rank_timeseries(matchups(spark, sf), DATES, profiles, [0.2, 0.8])
    path = fresh_folder(spark, "ranks")
    ranks.where("damping = 0.2").write.parquet(path)
    stored = keyed_upsert(spark.read.parquet(path), ranks, ["type", "direction", "damping", "date", "team"], ["rank"])
    return stored.withColumn("date", day_text("date")).withColumn("rank", r6("rank"))
