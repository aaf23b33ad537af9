"""Joins."""

from pyspark.sql import functions as F

from tablemill.operators import joins as ops
from tablemill.operators.aggregates import metric_rollup
from tablemill.registry import bindings
from tablemill.registry.base import day_text, query, r3, r6, table
from tablemill.session import settle


@query(
    "J01_inner_equi",
    "SELECT c_mktsegment, count(*) AS n, R6(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = ops.inner(o, table(spark, sf, "customer"), ["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("total"))


@query(
    "J02_left_enrich",
    """SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return ops.left_enrich(c, n, ["c_nationkey"], ["n_nationkey"]).select("c_custkey", "n_name", "n_regionkey")


@query(
    "J03_full_outer",
    """WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
            b AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1)
       SELECT user_id, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views FROM a FULL JOIN b USING (user_id)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"))
    b = e.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"))
    return ops.full(a, b, ["user_id"]).fillna(0)


@query(
    "J04_index_concat",
    """WITH a AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'click' GROUP BY 1),
            b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
            c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
            d AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
            e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
       SELECT user_id, a.n AS click_n, top AS click_top, b.n AS view_n, c.n AS error_n, d.n AS purchase_n, e.n AS signup_n
       FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id) FULL JOIN d USING (user_id) FULL JOIN e USING (user_id)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    n = F.count("*").alias("n")
    parts = {t: e.where(F.col("event_type") == t).groupBy("user_id").agg(n, *([F.max("value").alias("top")] if t == "click" else [])) for t in ("click", "view", "error", "purchase", "signup")}
    return ops.align_tables(parts, ["user_id"])


@query(
    "J05_exclusion_join",
    """WITH x AS (SELECT user_id, max(epoch_us(ts) // 1000000 // 604800) AS week FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1
                  UNION ALL SELECT DISTINCT user_id, CAST(NULL AS BIGINT) FROM events WHERE event_type = 'signup' AND value > 120)
       SELECT e.event_id, e.user_id FROM events e LEFT JOIN x USING (user_id)
       WHERE x.user_id IS NULL OR (x.week IS NOT NULL AND x.week - 1 > 2818)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    week = F.floor(F.unix_seconds("ts") / 604800)
    errors = e.where("event_type = 'error' AND value > 60").groupBy("user_id").agg(F.max(week).alias("week"))
    signups = e.where("event_type = 'signup' AND value > 120").select("user_id", F.lit(None).cast("long").alias("week")).distinct()
    return ops.exclusion_join(e.select("event_id", "user_id"), errors.unionByName(signups), "user_id", "week", 2818)


@query(
    "J06_semi_anti",
    """SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'in' ELSE 'out' END AS side,
              count(*) AS n FROM orders GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    inside = ops.members(o, poor, ["c_custkey"]).select(F.lit("in").alias("side"))
    outside = ops.members(o, poor, ["c_custkey"], negate=True).select(F.lit("out").alias("side"))
    return inside.unionByName(outside).groupBy("side").agg(F.count("*").alias("n"))


MENTIONS_SQL = "m AS (SELECT l_orderkey AS actor, 'h' || (l_partkey % 10) AS target, CAST(l_quantity AS BIGINT) AS followers FROM lineitem)"


def mentions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("actor"),
        F.concat(F.lit("h"), (F.col("l_partkey") % 10).cast("string")).alias("target"),
        F.col("l_quantity").cast("long").alias("followers"),
    )


FIRST, SECOND = ["h0", "h1", "h2"], ["h2", "h7", "h8"]


@query(
    "J07_cogroup_cross",
    f"""WITH {MENTIONS_SQL}
        SELECT a.actor, a.target AS target_a, b.target AS target_b, count(*) AS pairs, CAST(sum(a.followers) AS BIGINT) AS weight
        FROM m a JOIN m b ON a.actor = b.actor WHERE a.target IN ('h0', 'h1', 'h2') AND b.target IN ('h2', 'h7', 'h8') GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return ops.paired_mentions(mentions(spark, sf), "actor", "target", "followers", FIRST, SECOND)


@query(
    "J08_cross_product",
    "SELECT DISTINCT c_mktsegment, flag FROM customer, (VALUES ('A'), ('N'), ('R')) t(flag)",
)
def _(spark, sf):
    return ops.list_product(table(spark, sf, "customer"), "c_mktsegment", ["A", "N", "R"], "flag")


@query(
    "J09_lookup_with_default",
    """WITH r AS (SELECT o_orderpriority AS type, c_nationkey AS team, year(o_orderdate)::INT AS year, count(*) / 1000.0 AS rank
                  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY 1, 2, 3),
            d AS (SELECT type, year, 1.0 / count(DISTINCT team) AS dflt FROM r GROUP BY 1, 2),
            q AS (SELECT DISTINCT o_orderpriority AS type, c_nationkey AS team, year(o_orderdate)::INT AS year FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT q.type, q.team, q.year, R6(coalesce(rank, dflt)) AS rank FROM q LEFT JOIN r USING (type, team, year) LEFT JOIN d ON q.type = d.type AND q.year = d.year""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_orderpriority").alias("type"), F.col("c_nationkey").alias("team"), F.year("o_orderdate").alias("year"), "o_totalprice")
    ranks = o.where("o_totalprice > 400000").groupBy("type", "team", "year").agg((F.count("*") / 1000.0).alias("rank"))
    asked = o.select("type", "team", "year").distinct()
    found = ops.lookup_with_default(asked, ranks, ["type", "team", "year"], ["type", "year"], "team", "rank")
    return found.select("type", "team", "year", r6("rank").alias("rank"))


@query(
    "J10_expanding_prior",
    """SELECT * FROM (SELECT o_orderkey, R6(avg(o_totalprice) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate
                 RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)) AS prior FROM orders) WHERE prior IS NOT NULL""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
    return ops.expanding_prior(o, ["o_custkey", "year"], "day", "o_totalprice").select("o_orderkey", r6("prior").alias("prior"))


@query(
    "J11_mirror_union",
    f"""WITH {bindings.LINES_SQL}, g AS (SELECT DISTINCT date, least(team, opponent) AS a, greatest(team, opponent) AS b FROM lines)
        SELECT a AS team, b AS opponent, count(*) AS n FROM g GROUP BY 1, 2 UNION ALL SELECT b, a, count(*) FROM g GROUP BY 1, 2""",
)
def _(spark, sf):
    g = bindings.games(spark, sf).where("is_home").select("date", "team", "opponent")
    both = ops.mirror_union(g, "team", "opponent")
    return both.groupBy("team", "opponent").agg(F.count("*").alias("n"))


@query(
    "J12_second_degree",
    f"""WITH {bindings.STATS_SQL}, {bindings.GAMES_SQL},
        ts AS (SELECT date, opponent AS team, game, pos, metric, sum(value) AS value FROM stats GROUP BY ALL),
        spine AS (SELECT DISTINCT date, team FROM games),
        played AS (SELECT s.date, s.team, count(DISTINCT game) AS games FROM spine s JOIN ts t ON t.team = s.team AND t.date < s.date GROUP BY 1, 2),
        sums AS (SELECT s.date, s.team, pos, metric, sum(value) AS total FROM spine s JOIN ts t ON t.team = s.team AND t.date < s.date GROUP BY ALL)
        SELECT strftime(date, '%Y-%m-%d') AS day, team, pos, metric || ':2nd' AS metric, R6(total / games) AS value FROM sums JOIN played USING (date, team)""",
)
def _(spark, sf):
    got = ops.second_degree(bindings.games(spark, sf), bindings.stats(spark, sf))
    return got.select(day_text("date").alias("day"), "team", "pos", "metric", r6("value").alias("value"))


@query(
    "J13_zero_fill_counts",
    """WITH e AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
            d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
       SELECT c_custkey, coalesce(d.n, 0) AS declared_count, coalesce(e.n, 0) AS event_count, CAST(coalesce(d.n, 0) = coalesce(e.n, 0) AS INT) AS agrees
       FROM customer LEFT JOIN e ON e.o_custkey = c_custkey LEFT JOIN d ON d.o_custkey = c_custkey""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    declared = o.where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("declared"))
    c = table(spark, sf, "customer").select("c_custkey").join(declared, "c_custkey", "left").fillna(0)
    got = ops.zero_fill_counts(c, "c_custkey", "declared", o.where("o_orderstatus = 'P'"), "o_custkey")
    return got.withColumn("agrees", F.col("agrees").cast("int"))


@query(
    "J14_source_preference",
    """SELECT c_custkey AS id, 'customer' AS source FROM customer WHERE c_acctbal > 5000
       UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
       UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
                 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("source"))
    return ops.source_preference([a, b, c], "id")


@query(
    "J15_fill_from_answers",
    """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
       SELECT c_custkey, R6(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_nationkey < 5 THEN total ELSE c_acctbal END) AS response
       FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
)
def _(spark, sf):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    own = F.when(k % 3 == 0, "hidden").when((k % 3 != 1) | (nation >= 5), F.col("c_acctbal").cast("string"))
    c = table(spark, sf, "customer").select("c_custkey", own.alias("response"))
    answers = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("response"))
    return ops.fill_from_answers(c, answers, "c_custkey", "response").select("c_custkey", r6("response").alias("response"))


@query(
    "J16_value_conflicts",
    """WITH a AS (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1),
            b AS (SELECT user_id, count(*) AS n, sum(value) AS total FROM events WHERE value < 100 GROUP BY 1)
       SELECT user_id, 'n' AS feature, R6(abs(a.n - b.n)) AS difference FROM a JOIN b USING (user_id) WHERE a.n <> b.n
       UNION ALL SELECT user_id, 'total', R6(abs(a.total - b.total)) FROM a JOIN b USING (user_id) WHERE a.n <> b.n""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    aggs = [F.count("*").alias("n"), (F.round(F.sum("value") * 100) / 100).alias("total")]
    a, b = e.groupBy("user_id").agg(*aggs), e.where("value < 100").groupBy("user_id").agg(*aggs)
    return ops.value_conflicts(a, b, "user_id", ["n", "total"]).select("user_id", "feature", r6("difference").alias("difference"))


@query(
    "J17_code_mapping",
    """WITH l AS (SELECT DISTINCT CASE c_mktsegment WHEN 'MACHINERY' THEN 'MCH' ELSE upper(substr(c_mktsegment, 1, 3)) END AS code FROM customer),
            r AS (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'AUT' WHEN 'PROMO' THEN 'BUI' ELSE upper(substr(p_type, 1, 3)) END AS code FROM part)
       SELECT code, 'left' AS side FROM l WHERE code NOT IN (SELECT code FROM r)
       UNION ALL SELECT code, 'right' FROM r WHERE code NOT IN (SELECT code FROM l)""",
)
def _(spark, sf):
    left = ops.map_codes(table(spark, sf, "customer"), "c_mktsegment", {"MACHINERY": "MCH"})
    right = ops.map_codes(table(spark, sf, "part"), "p_type", {"ECONOMY": "AUT", "PROMO": "BUI"})
    return ops.unmatched_codes(left, right, "code")


@query(
    "J18_nearest_row",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
            c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
            d AS (SELECT vec_id, c.label AS nearest_id, sqrt(sum((x - m) * (x - m))) AS distance FROM e JOIN c USING (i) GROUP BY 1, 2)
       SELECT vec_id, arg_min(nearest_id, distance)::BIGINT AS nearest_id, R6(min(distance)) AS distance FROM d GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("cells"))  # 64 cells per label
    centres = centres.select("label", F.col("cells.m").alias("centre"))
    near = ops.nearest_row(e.select("vec_id", "embedding"), "embedding", centres, "label", "centre")
    return near.select("vec_id", "nearest_id", r6("distance").alias("distance"))


def _context_sql() -> str:
    """Wide states per (date, team) and (date, team, player), then four joins to the seats."""
    word = lambda m: m.split(":")[1].lower()
    cells = [(p, m) for p in "LS" for m in bindings.METRICS]
    wide = ", ".join(f"sum(value) FILTER (pos = '{p}' AND metric = '{m}') / count(DISTINCT game) AS {p.lower()}_{word(m)}" for p, m in cells)
    own = ", ".join(f"sum(value) FILTER (metric = '{m}') / count(DISTINCT game) AS {word(m)}" for m in bindings.METRICS)
    result = ", ".join(f"sum(value) FILTER (metric = '{m}') AS {word(m)}" for m in bindings.METRICS)
    shown = [f"{p.lower()}_{word(m)}" for p, m in cells]
    out = [f"R3(avg({side}.{c})) AS {label}_{c}" for side, label in (("a", "team"), ("b", "opp"), ("c", "team2"), ("d", "opp2")) for c in shown]
    out += [f"R3(avg({side}.{word(m)})) AS {label}_{word(m)}" for side, label in (("p", "player"), ("r", "result")) for m in bindings.METRICS]
    return f"""WITH {bindings.STATS_SQL}, {bindings.GAMES_SQL}, {bindings.TEAMS_SQL},
        roster AS (SELECT DISTINCT team, player, pos FROM stats),
        spine AS (SELECT DISTINCT date, team FROM games),
        h1 AS (SELECT s.date, s.team, {wide} FROM spine s JOIN teams t ON t.team = s.team AND t.date < s.date GROUP BY 1, 2),
        h2 AS (SELECT s.date, s.team, {wide} FROM spine s JOIN teams t ON t.opponent = s.team AND t.date < s.date GROUP BY 1, 2),
        box AS (SELECT date, team, player, game, metric, sum(value) AS value FROM stats GROUP BY ALL),
        seats AS (SELECT g.*, player, pos FROM games g JOIN roster USING (team)),
        past AS (SELECT s.date, s.team, s.player, count(DISTINCT game) AS games, {own}
                 FROM (SELECT DISTINCT date, team, player FROM seats) s JOIN box USING (team, player) WHERE box.date < s.date GROUP BY 1, 2, 3),
        res AS (SELECT date, game, team, player, {result} FROM box GROUP BY ALL)
        SELECT s.team, s.player, s.pos, CAST(is_home AS INT) AS is_home, count(*) AS n, CAST(sum(p.games) AS BIGINT) AS contributed, {", ".join(out)}
        FROM seats s LEFT JOIN h1 a ON a.date = s.date AND a.team = s.team LEFT JOIN h1 b ON b.date = s.date AND b.team = s.opponent
             LEFT JOIN h2 c ON c.date = s.date AND c.team = s.team LEFT JOIN h2 d ON d.date = s.date AND d.team = s.opponent
             LEFT JOIN past p ON p.date = s.date AND p.team = s.team AND p.player = s.player
             LEFT JOIN res r ON r.game = s.game AND r.team = s.team AND r.player = s.player GROUP BY s.team, s.player, s.pos, is_home"""


@query("J19_self_context", _context_sql())
def _(spark, sf):
    stats = settle(bindings.stats(spark, sf), "stats")
    games = settle(bindings.games(spark, sf), "games")
    teams = settle(metric_rollup(stats, ["date", "team", "opponent", "game", "pos"]), "teams")
    cells, metrics = ops.cell_names(teams), [(m,) for m in bindings.METRICS]
    roster = stats.select("team", "player", "pos").distinct()
    places = ops.seats(games, roster)
    box = settle(stats.groupBy("date", "team", "player", "game", "metric").agg(F.sum("value").alias("value")), "box")
    past = ops.past_averages(places.select("date", "team", "player").distinct(), box, ["team", "player"], metrics, ["metric"])
    results = box.groupBy("game", "team", "player").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in bindings.METRICS])
    rows = ops.game_context(places, ops.team_states(games, teams, cells), past, results)
    word = lambda m: m.split(":")[1].lower()
    shown = [(f"{family}:{p}:{m}:{label}", f"{short}_{p.lower()}_{word(m)}") for family, label, short in (("Team", "1st", "team"), ("Opp", "1st", "opp"), ("Team", "2nd", "team2"), ("Opp", "2nd", "opp2")) for p, m in cells]
    shown += [(f"{family}:{m}", f"{family.lower()}_{word(m)}") for family in ("Player", "Result") for m in bindings.METRICS]
    grouped = rows.groupBy("team", "player", "pos", F.col("is_home").cast("int").alias("is_home"))
    return grouped.agg(F.count("*").alias("n"), F.sum("`Player:games`").alias("contributed"), *[r3(F.avg(f"`{c}`")).alias(a) for c, a in shown])
