"""Complete jobs."""

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tablemill.plans import jobs
from tablemill.registry import bindings
from tablemill.registry.aggregates import RANKS_SQL, team_ranks
from tablemill.registry.base import day_text, query, r3, r6, table
from tablemill.registry.evaluation import FEATURES, _classifiers, labelled
from tablemill.registry.joins import FIRST, MENTIONS_SQL, SECOND, mentions
from tablemill.registry.series import METRIC_IDS, UNSTACK_SQL, metric_index
from tablemill.session import fresh_folder, settle
from tablemill.sources import tables


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


@query(
    "Q01_chart",
    """WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM events),
       s AS (SELECT user_id, value FROM e WHERE event_type = 'purchase' AND value < 100 AND t BETWEEN 2819 * 604800 - 259200 AND 2819 * 604800 + 345599
             QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, value DESC) = 1),
       x AS (SELECT user_id, min(t // 86400 // 7) AS week FROM e WHERE event_type = 'error' AND value > 100 GROUP BY 1
             UNION ALL SELECT DISTINCT user_id, NULL::BIGINT FROM e WHERE event_type = 'signup' AND value > 150 AND event_id % 3 > 0
             UNION ALL SELECT user_id, NULL FROM (SELECT user_id, event_id % 4 AS c FROM e WHERE event_type = 'view' AND event_id % 5 > 0
                       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_id % 4) = 1) WHERE c <> 1),
       r AS (SELECT s.user_id, value, row_number() OVER (ORDER BY value DESC, s.user_id DESC) AS position FROM s LEFT JOIN x USING (user_id)
             WHERE x.user_id IS NULL OR (x.week IS NOT NULL AND x.week - 1 > 2819) QUALIFY position <= 1500)
       SELECT user_id AS entity_id, position, R6(value) AS value, c_name AS entity_name, (position % 10)::INT AS bucket FROM r JOIN customer ON c_custkey = user_id""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("entity_id", F.col("user_id"))
    second = F.unix_seconds("ts")
    metric = F.lit(None).cast("int")
    for name, number in METRIC_IDS.items():
        metric = F.when(F.col("event_type") == name, number).otherwise(metric)
    index = e.select("entity_id", metric.alias("metric_id"), F.lit("d").alias("count_type"), second.alias("unix_seconds"), "value")
    record = F.to_json(F.create_map(F.lit("artist_id"), F.col("user_id").cast("string"), F.lit("day"), F.floor(second / 86400).cast("string")))
    prior = tables.map_fields(e.where("event_type = 'error' AND value > 100").select(record.alias("record")), "record", {"artist_id": "long", "day": "long"})
    prior = prior.select(F.col("artist_id").alias("entity_id"), F.floor(F.col("day") / 7).alias("week"))
    exceptions = e.where("event_type = 'signup' AND value > 150").select("entity_id", F.when(F.col("event_id") % 3 > 0, "No").otherwise("yes").alias("active"))
    categories = e.where("event_type = 'view'").select(
        "entity_id", (F.col("event_id") % 4).alias("category_id"), F.col("event_id").alias("rank_value"), F.when(F.col("event_id") % 5 == 0, "gone").alias("deleted_at")
    )
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"))
    top = jobs.chart(index, prior, exceptions, categories, names, METRIC_IDS["purchase"], 2819)
    path = fresh_folder(spark, "chart")
    tables.bucketed_write(top, path, "position", 10)
    return _r6(spark.read.parquet(path).select("entity_id", "position", "value", "entity_name", "bucket"), "value")


@query(
    "Q02_affinity",
    f"""WITH {MENTIONS_SQL}, u AS (SELECT actor, target, max(followers) AS followers FROM m GROUP BY 1, 2),
        a AS (SELECT a.target AS target_a, b.target AS target_b, sum(a.followers)::BIGINT AS affinity FROM m a JOIN m b USING (actor) WHERE a.target IN ('h0', 'h1', 'h2') AND b.target IN ('h2', 'h7', 'h8') GROUP BY 1, 2),
        o AS (SELECT a.target AS target_a, b.target AS target_b, sum(a.followers)::BIGINT AS unique_affinity FROM u a JOIN u b USING (actor) WHERE a.target IN ('h0', 'h1', 'h2') AND b.target IN ('h2', 'h7', 'h8') GROUP BY 1, 2)
        SELECT target_a, target_b, affinity, unique_affinity FROM a JOIN o USING (target_a, target_b)""",
)
def _(spark, sf):
    return jobs.affinity(mentions(spark, sf), FIRST, SECOND)


@query("Q03_unstack", UNSTACK_SQL)
def _(spark, sf):
    got = jobs.unstack(metric_index(spark, sf), pre_aggregated=[44])
    return _r6(got, "delta_value", "total_value").withColumn("is_interpolated", F.col("is_interpolated").cast("int"))


@query(
    "Q04_measurement_view",
    """WITH noted AS (SELECT s_nationkey AS project, l_suppkey AS point, date_trunc('month', l_shipdate)::DATE AS date, l_linestatus AS meta, l_returnflag AS f, l_linenumber AS no, l_quantity AS q
                      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
       conv AS (SELECT project, point, date, meta, CASE f WHEN 'R' THEN 'Lead' WHEN 'A' THEN 'Temperature' ELSE 'Total Coliforms' END AS parameter,
                  CASE WHEN f = 'R' AND no >= 4 THEN q / 1000.0::DOUBLE WHEN f = 'R' THEN q WHEN f = 'A' AND no >= 4 THEN (q - 32.0) * (5 / 9.0::DOUBLE) WHEN f = 'A' THEN q WHEN no = 1 THEN 5000 WHEN no = 2 THEN NULL ELSE q END AS v FROM noted),
       med AS (SELECT * FROM conv WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, point, parameter, date ORDER BY v, meta) = count(*) OVER (PARTITION BY project, point, parameter, date) // 2 + 1),
       modes AS (SELECT project, point, date, meta FROM (SELECT project, point, date, meta, count(*) AS n FROM med GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project, point, date ORDER BY n DESC, meta) = 1),
       wide AS (SELECT project, point, date, max(v) FILTER (parameter = 'Lead') AS lead, max(v) FILTER (parameter = 'Temperature') AS temp, max(v) FILTER (parameter = 'Total Coliforms') AS coli FROM med GROUP BY 1, 2, 3),
       late AS (SELECT * FROM wide JOIN modes USING (project, point, date) JOIN nation ON n_nationkey = project QUALIFY row_number() OVER (PARTITION BY project, point ORDER BY date DESC) = 1)
       SELECT project || ':' || point || ' (' || n_name || ' | P' || point || ')' AS identifier, strftime(date, '%Y-%m-%d') AS month, meta, R6(log10(lead)) AS lead, R6(temp) AS temperature, R6(coli) AS coliforms,
              R6(avg(log10(lead)) OVER ()) AS bench_lead, R6(avg(temp) OVER (PARTITION BY n_regionkey)) AS bench_temperature FROM late""",
)
def _(spark, sf):
    f, no, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    parameter = F.when(f == "R", "Lead").when(f == "A", "Temperature").otherwise("Total Coliforms")
    unit = F.when(f == "R", F.when(no < 4, "mg/L").otherwise("ppb")).when(f == "A", F.when(no < 4, "Celsius").otherwise("Fahrenheit")).otherwise("CFU/100ml")
    count = F.when(no == 1, "TNTC").when(no == 2, "see note").otherwise(q.cast("string"))
    tests = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("project"), F.col("l_suppkey").alias("point"), parameter.alias("parameter"), unit.alias("unit"),
        F.when(f.isin("R", "A"), q.cast("string")).otherwise(count).alias("value"), F.trunc("l_shipdate", "month").alias("date"), F.col("l_linestatus").alias("meta"),
    )
    projects = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("project_name"), F.col("n_regionkey").alias("country"))
    v = jobs.measurement_view(tests, projects, ["Lead", "Temperature", "Total Coliforms"], ["meta"])
    return v.select(
        "identifier", day_text("date").alias("month"), "meta", r6("WQ_Lead_Log").alias("lead"), r6("WQ_Temperature").alias("temperature"),
        r6(F.col("`WQ_Total Coliforms`")).alias("coliforms"), r6(F.col("`BenchAll.WQ_Lead_Log`")).alias("bench_lead"), r6(F.col("`BenchCountry.WQ_Temperature`")).alias("bench_temperature"),
    )


@query(
    "Q05_project_timeline_view",
    """WITH m AS (SELECT o_custkey AS id, date_trunc('month', o_orderdate)::DATE AS date, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS sales, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS other,
                         sum(o_totalprice) FILTER (o_orderstatus = 'P') AS parts FROM orders GROUP BY 1, 2),
       k AS (SELECT * FROM m JOIN customer ON c_custkey = id WHERE NOT contains(c_name, '#00000013')),
       f AS (SELECT id, date, c_nationkey AS country, last_value(sales IGNORE NULLS) OVER w AS sales, last_value(other IGNORE NULLS) OVER w AS other, last_value(parts IGNORE NULLS) OVER w AS parts,
                    lead(date) OVER (PARTITION BY id ORDER BY date) AS nxt FROM k WINDOW w AS (PARTITION BY id ORDER BY date)),
       g AS (SELECT *, unnest(generate_series(date::TIMESTAMP, coalesce(nxt - INTERVAL 1 MONTH, date::TIMESTAMP), INTERVAL 1 MONTH)) AS pt FROM f),
       n AS (SELECT id, pt, country, (pt <> date)::INT AS interpolated, coalesce(sales, 0) + coalesce(other, 0) - coalesce(parts, 0) AS net FROM g)
       SELECT id, strftime(pt, '%Y-%m-%d') AS month, interpolated, R6(net) AS net, R6(avg(net) OVER (PARTITION BY pt)) AS bench_all, R6(avg(net) OVER (PARTITION BY pt, country)) AS bench_country FROM n""",
)
def _(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"))

    def total(status):
        return F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")))

    timeline = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "month").alias("date")).agg(
        total("F").alias("IncomeSales"), total("O").alias("IncomeOther"), total("P").alias("ExpensesParts")
    )
    v = jobs.project_timeline_view(projects, timeline, ["name", "country"], ["IncomeSales", "IncomeOther", "ExpensesParts"], ["IncomeNet"], test_words=["#00000013"])
    return v.select(
        "id", day_text("date").alias("month"), F.col("interpolated").cast("int").alias("interpolated"), r6("IncomeNet").alias("net"),
        r6(F.col("`BenchAll.IncomeNet`")).alias("bench_all"), r6(F.col("`BenchCountry.IncomeNet`")).alias("bench_country"),
    )


def _word(metric: str) -> str:
    return metric.split(":")[1].lower()


def _matrix_sql() -> str:
    """The job with one column for each statistic, written out from the list of metrics."""
    cells = [(p, m) for p in "LS" for m in bindings.METRICS]
    wide = ", ".join(f"sum(value) FILTER (pos = '{p}' AND metric = '{m}') / count(DISTINCT game) AS {p.lower()}_{_word(m)}" for p, m in cells)
    own = ", ".join(
        f"sum(value) FILTER (metric = '{m}') / max(games) AS {_word(m)}, " + ", ".join(f"sum(value * r{d}) FILTER (metric = '{m}') / max(games) AS {_word(m)}_{d}" for d in ("20", "80"))
        for m in bindings.METRICS
    )
    result = ", ".join(f"sum(value) FILTER (metric = '{m}') AS {_word(m)}" for m in bindings.METRICS)
    out = []
    for m in map(_word, bindings.METRICS):
        out += [f"R3(a.s_{m}) AS team_s_{m}", f"R3(b.l_{m}) AS opp_l_{m}", f"R3(c.s_{m}) AS second_s_{m}", f"R3(d.l_{m}) AS second_opp_l_{m}", f"R3(a.s_{m} - b.s_{m}) AS diff_s_{m}"]
        out += [f"R3(p.{m}) AS past_{m}", f"R3(p.{m}_20 / k.r20) AS adjusted_20_{m}", f"R3(p.{m}_80 / k.r80) AS adjusted_80_{m}", f"R3(q.{m}) AS result_{m}"]
    return f"""WITH {bindings.STATS_SQL}, {bindings.GAMES_SQL}, {bindings.TEAMS_SQL}, {RANKS_SQL},
        rk AS (SELECT opponent, max(coalesce(rank, d0)) FILTER (damping = '20') AS r20, max(coalesce(rank, d0)) FILTER (damping = '80') AS r80
               FROM (SELECT DISTINCT opponent FROM games) CROSS JOIN dflt LEFT JOIN ranks USING (damping, opponent) GROUP BY 1),
        spine AS (SELECT DISTINCT date, team FROM games),
        h1 AS (SELECT s.date, s.team, {wide} FROM spine s JOIN teams t ON t.team = s.team AND t.date < s.date GROUP BY 1, 2),
        h2 AS (SELECT s.date, s.team, {wide} FROM spine s JOIN teams t ON t.opponent = s.team AND t.date < s.date GROUP BY 1, 2),
        num AS (SELECT game, team, is_home, row_number() OVER (PARTITION BY team, year(date) ORDER BY date, opponent) AS game_number FROM games),
        box AS (SELECT date, game, team, opponent, player, metric, sum(value) AS value FROM stats GROUP BY ALL),
        res AS (SELECT game, date, team, opponent, player, {result} FROM box GROUP BY 1, 2, 3, 4, 5),
        rows AS (SELECT res.game, res.team, date, opponent, player, yds AS response, game_number, is_home FROM res JOIN num USING (game, team) WHERE game_number >= 8),
        best AS (SELECT player FROM (SELECT player, row_number() OVER (ORDER BY avg(response) DESC, player) AS no, count(*) OVER () AS n FROM rows GROUP BY 1) WHERE no <= floor(n * 0.5)),
        kept AS (SELECT rows.* FROM rows JOIN best USING (player)),
        faced AS (SELECT r.team, r.player, r.date, game, metric, value, r20, r80, count(DISTINCT game) OVER (PARTITION BY r.team, r.player, r.date) AS games
                  FROM (SELECT DISTINCT team, player, date FROM kept) r JOIN box x ON x.team = r.team AND x.player = r.player AND x.date < r.date JOIN rk ON rk.opponent = x.opponent),
        past AS (SELECT team, player, date, max(games) AS games, {own} FROM faced GROUP BY 1, 2, 3)
        SELECT r.game, r.team, r.player, game_number, is_home::INT AS is_home, p.games AS contributed, R3(response) AS response, {", ".join(out)}
        FROM kept r JOIN rk k ON k.opponent = r.opponent LEFT JOIN h1 a ON a.date = r.date AND a.team = r.team LEFT JOIN h1 b ON b.date = r.date AND b.team = r.opponent
             LEFT JOIN h2 c ON c.date = r.date AND c.team = r.team LEFT JOIN h2 d ON d.date = r.date AND d.team = r.opponent
             LEFT JOIN past p ON p.date = r.date AND p.team = r.team AND p.player = r.player LEFT JOIN res q ON q.game = r.game AND q.team = r.team AND q.player = r.player"""


@query("Q06_training_matrix", _matrix_sql())
def _(spark, sf):
    games = settle(bindings.games(spark, sf), "games")
    matrix = jobs.training_matrix(bindings.stat_tables(spark, sf), ["game", "team", "player", "pos"], games, settle(team_ranks(spark, sf), "ranks"), "passing:Yds")
    c = lambda n, name: r3(F.col(f"`{n}`")).alias(name)
    out = []
    for m in bindings.METRICS:
        w = _word(m)
        out += [c(f"Team:S:{m}:1st", f"team_s_{w}"), c(f"Opp:L:{m}:1st", f"opp_l_{w}"), c(f"Team:S:{m}:2nd", f"second_s_{w}"), c(f"Opp:L:{m}:2nd", f"second_opp_l_{w}"), c(f"Diff:S:{m}", f"diff_s_{w}")]
        out += [c(f"Player:{m}", f"past_{w}"), c(f"Player:{m}:Adj:20", f"adjusted_20_{w}"), c(f"Player:{m}:Adj:80", f"adjusted_80_{w}"), c(f"Result:{m}", f"result_{w}")]
    return matrix.select(
        "game", "team", "player", "game_number", F.col("is_home").cast("int").alias("is_home"), F.col("`Player:ContribG`").alias("contributed"), r3("response").alias("response"), *out
    )


@query(
    "Q07_entity_feature_table",
    """WITH h AS (SELECT user_id AS uid, round_even(epoch_us(ts) / 3.6e9, 0)::BIGINT * 3600 AS t, max(value) AS v FROM events GROUP BY 1, 2),
       s AS (SELECT uid, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER (PARTITION BY uid) AS lo FROM h WINDOW w AS (PARTITION BY uid ORDER BY t)),
       g AS (SELECT *, unnest(generate_series(t0, coalesce(t1 - 3600, t0), 3600)) AS pt FROM s),
       d AS (SELECT uid, (pt - lo) / 60 AS mi, CASE WHEN (pt - t0) / 3600 <= 4 THEN v0 + coalesce((v1 - v0) * ((pt - t0) / (t1 - t0)), 0) END AS v FROM g),
       a AS (SELECT uid, avg(v) AS mean, quantile_cont(v, 0.5) AS p500, count(*) FILTER (v > 0 AND v < 5) AS under5, coalesce(avg(v) FILTER (v > 100), 100) AS over100,
                    coalesce(count(*) FILTER (mi <= 4320 AND v > 0 AND v >= 20 AND v < 60) / NULLIF(count(*) FILTER (mi <= 4320 AND v > 0), 0), 0) AS middle,
                    count(*) FILTER (mi <= 4320 AND v > 5 AND v <= 20) AS bin1 FROM d GROUP BY 1)
       SELECT coalesce(uid, c_custkey) AS uid, R6(mean) AS mean, R6(p500) AS median, under5, R6(over100) AS over100, R6(middle) AS middle, bin1,
              CASE WHEN c_nationkey % 6 IN (2, 3) THEN 0 WHEN c_nationkey % 6 IN (4, 5) THEN 1 END AS favalive, (NULLIF(c_nationkey % 6, 0) > 1)::INT AS alive
       FROM a FULL JOIN customer ON c_custkey = uid""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("ts").alias("at"), "value")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.nullif(F.col("c_nationkey") % 6, F.lit(0)).alias("gos-3"))
    t = jobs.entity_feature_table(e, c)
    return t.select(
        "uid", r6("value_mean").alias("mean"), r6("value_p500").alias("median"), F.col("value_n_under_5").alias("under5"), r6("value_mean_over_100").alias("over100"),
        r6("share_middle").alias("middle"), F.col("bin_1").alias("bin1"), F.col("`gos-3-favalive`").alias("favalive"), F.col("`gos-3-alive`").alias("alive"),
    )


@query(
    "Q08_source_merge",
    """WITH s AS (SELECT s_suppkey * 7 AS id, 's' AS kind, s_acctbal AS a, 1.0::DOUBLE AS b, 'x,y' AS l FROM supplier),
       c AS (SELECT c_custkey AS id, 'c' AS kind, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS a, c_acctbal / 2 AS b, 'x' AS l FROM customer WHERE c_custkey NOT IN (SELECT id FROM s)),
       u AS (SELECT * FROM s UNION ALL SELECT * FROM c),
       ans AS (SELECT o_custkey AS id, max(o_totalprice) AS t FROM orders GROUP BY 1),
       f AS (SELECT u.id, kind, coalesce(a, t) AS a, b, l FROM u LEFT JOIN ans USING (id)),
       n AS (SELECT user_id AS id, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'click' GROUP BY 1), w AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
       j AS (SELECT f.*, n.n AS cn, n.top AS ct, w.n AS vn, f.id % 5 AS country FROM f JOIN (SELECT id FROM n UNION SELECT id FROM w) k USING (id) LEFT JOIN n USING (id) LEFT JOIN w USING (id) WHERE ((n.n IS NULL)::INT + (n.top IS NULL)::INT + (w.n IS NULL)::INT) / 3 <= 0.5)
       SELECT id, kind, country, R6(CASE WHEN a IS NOT NULL THEN (a - avg(a) OVER k) / stddev_samp(a) OVER k ELSE (b - avg(b) OVER k) / stddev_samp(b) OVER k END) AS response,
              R6((cn - avg(cn) OVER ()) / stddev_samp(cn) OVER ()) AS click_n, R6((ct - avg(ct) OVER ()) / stddev_samp(ct) OVER ()) AS click_top, R6((vn - avg(vn) OVER ()) / stddev_samp(vn) OVER ()) AS view_n,
              contains(l, 'y')::INT AS "l:y" FROM j WINDOW k AS (PARTITION BY kind)""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 7).alias("id"), F.lit("s").alias("kind"), F.col("s_acctbal").cast("string").alias("a"), F.lit(1.0).alias("b"), F.lit("x,y").alias("l")
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast("string")).otherwise("hidden").alias("a"),
        (F.col("c_acctbal") / 2).alias("b"), F.lit("x").alias("l"),
    )
    answers = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("a"))
    e = table(spark, sf, "events")
    by = {t: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("id"), (F.col("user_id") % 5).alias("country")) for t in ("click", "view")}
    rare = F.max(F.when(F.col("event_id") % 200 == 0, F.col("value"))).alias("rare")  # too sparse to be kept
    feature_tables = {"click": by["click"].agg(F.count("*").alias("n"), F.max("value").alias("top")), "view": by["view"].agg(F.count("*").alias("n"), rare)}
    got = jobs.source_merge([s, c], answers, feature_tables, "id", "kind", "a", "b", "l", agree=["country"])
    if "view_rare" in got.columns:
        raise ValueError("a sparse feature was kept")
    return _r6(got.select("id", "kind", "country", "response", "click_n", "click_top", "view_n", "`l:y`"), "response", "click_n", "click_top", "view_n")


@query("Q09_call_classifier")
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    calls = o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("business"), F.to_date("o_orderdate").alias("day"),
        F.format_string("%02d:%02dAM", (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_custkey") % 60).cast("int")).alias("clock"),
        F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("o_custkey").cast("string")).alias("number"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("origin"), (F.col("o_totalprice") / 1000).alias("minutes"), (F.col("o_orderkey") % 3).cast("int").alias("fold"),
    )
    _, summary = jobs.call_classifier(settle(calls, "raw_calls"), lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1))
    return summary


@query("Q10_evaluation_report")
def _(spark, sf):
    shallow = {"stump": lambda: DecisionTreeClassifier(maxDepth=1, seed=1)}
    return jobs.evaluation_report(labelled(spark, sf), ["doc_id"], FEATURES, "quality", _classifiers() | shallow, "fold", 3)
