"""Aggregations."""

import math

from pyspark.sql import functions as F

from tablemill.operators import aggregates as ops
from tablemill.registry import bindings
from tablemill.registry.base import query, r6, table
from tablemill.registry.joins import FIRST, MENTIONS_SQL, SECOND, mentions


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


@query(
    "A01_group_sum_order",
    "SELECT l_returnflag, l_linestatus, R6(sum(l_quantity)) AS total FROM lineitem GROUP BY 1, 2 ORDER BY total DESC",
)
def _(spark, sf):
    return _r6(ops.group_sum(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "total"), "total")


@query(
    "A02_pair_affinity",
    f"""WITH {MENTIONS_SQL} SELECT a.target AS target_a, b.target AS target_b, CAST(sum(a.followers) AS BIGINT) AS affinity
        FROM m a JOIN m b ON a.actor = b.actor WHERE a.target IN ('h0', 'h1', 'h2') AND b.target IN ('h2', 'h7', 'h8') GROUP BY 1, 2""",
)
def _(spark, sf):
    return ops.pair_affinity(mentions(spark, sf), "actor", "target", "followers", FIRST, SECOND)


@query("A03_min_per_group", "SELECT user_id, min(epoch_us(ts) // 1000000 // 604800) AS week FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.unix_seconds("ts") / 604800).alias("week"))
    return ops.min_per_group(e, ["user_id"], "week", "week")


@query(
    "A04_distinct_count",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS n, l_suppkey || ' [' || count(DISTINCT l_partkey) || ']' AS label FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return ops.distinct_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query(
    "A05_value_counts",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, R6(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)) AS share
       FROM orders GROUP BY 1, 2""",
)
def _(spark, sf):
    return _r6(ops.value_counts(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus"), "share")


ROLLUP_SQL = f"""WITH {bindings.STATS_SQL},
   m AS (SELECT date, team, pos, metric, player, sum(value) AS v, max(value) AS top FROM stats GROUP BY ALL),
   w AS (SELECT date, team, pos, player, v AS w FROM m WHERE metric = 'passing:Att')"""


@query(
    "A06_metric_rollup",
    f"""{ROLLUP_SQL} SELECT team, pos, metric, count(*) AS n, R6(sum(value)) AS total FROM (
          SELECT date, team, pos, metric, CASE metric WHEN 'passing:Lg' THEN max(top) WHEN 'passing:YPA' THEN sum(v * w) / sum(w) ELSE sum(v) END AS value
          FROM m JOIN w USING (date, team, pos, player) GROUP BY date, team, pos, metric) GROUP BY team, pos, metric""",
)
def _(spark, sf):
    rolled = ops.metric_rollup(bindings.stats(spark, sf), ["date", "team", "pos"])
    return rolled.groupBy("team", "pos", "metric").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "A07_metric_rollup_legacy",
    f"""WITH {bindings.STATS_SQL} SELECT team, metric, R6(CASE WHEN metric IN ('passing:Lg', 'passing:YPA') THEN avg(value) ELSE sum(value) END) AS value
        FROM stats GROUP BY team, metric""",
)
def _(spark, sf):
    return _r6(ops.metric_rollup_by_suffix(bindings.stats(spark, sf), ["team"]), "value")


@query(
    "A08_per_game_average",
    f"""WITH {bindings.STATS_SQL}, g AS (SELECT team, count(DISTINCT game) AS games FROM stats GROUP BY 1)
        SELECT team, pos, metric, games, R6(sum(value) / games) AS value FROM stats JOIN g USING (team) GROUP BY team, pos, metric, games""",
)
def _(spark, sf):
    return _r6(ops.per_game_average(bindings.stats(spark, sf), ["team"], "game", ["pos", "metric"]), "value")


def team_ranks(spark, sf):
    """Strength of a team: its share of all sold quantity, mixed with the uniform share."""
    share = bindings.lines(spark, sf).where("team < 20").groupBy(F.col("team").alias("opponent")).agg(F.sum("q").alias("q"))
    share = ops.attach(share, [], {"_all": F.sum("q"), "_n": F.count("*")})
    cells = [
        F.struct(F.lit(d).alias("damping"), (int(d) / 100 / F.col("_n") + (1 - int(d) / 100) * F.col("q") / F.col("_all")).alias("rank"))
        for d in ("20", "80")
    ]
    return share.select("opponent", F.inline(F.array(*cells)))


RANKS_SQL = """ranks AS (SELECT d AS damping, opponent, (d::INT / 100.0::DOUBLE) / count(*) OVER (PARTITION BY d) + (1 - d::INT / 100.0::DOUBLE) * q / sum(q) OVER (PARTITION BY d) AS rank
  FROM (SELECT team AS opponent, sum(q) AS q FROM lines WHERE team < 20 GROUP BY 1), (VALUES ('20'), ('80')) v(d)),
dflt AS (SELECT damping, 1.0::DOUBLE / count(DISTINCT opponent) AS d0 FROM ranks GROUP BY 1)"""


@query(
    "A09_strength_adjusted",
    f"""WITH {bindings.STATS_SQL}, {RANKS_SQL},
        g AS (SELECT team, count(DISTINCT game) AS n FROM stats GROUP BY 1),
        a AS (SELECT team, pos, metric, damping, n, sum(value) / n AS v, sum(value * coalesce(rank, d0)) / n AS a
              FROM stats JOIN g USING (team) CROSS JOIN dflt LEFT JOIN ranks USING (damping, opponent) GROUP BY team, pos, metric, damping, n)
        SELECT team, pos, metric, a.damping AS damping, n, R6(v) AS v, R6(a) AS a, R6(a / coalesce(rank, d0)) AS adjusted
        FROM a JOIN dflt USING (damping) LEFT JOIN ranks r ON r.damping = a.damping AND r.opponent = (a.team + 1) % 25""",
)
def _(spark, sf):
    ranks = team_ranks(spark, sf)
    a = ops.strength_adjusted(bindings.stats(spark, sf), ranks, ["team"], ["pos", "metric"], "game").withColumn("next_opponent", (F.col("team") + 1) % 25)
    return _r6(ops.resolve_adjusted(a, ranks, "next_opponent").drop("next_opponent"), "v", "a", "adjusted")


@query(
    "A10_weighted_mean_with_fallback",
    """SELECT l_partkey, R6(CASE WHEN sum(w) = 0 THEN avg(x) FILTER (w IS NOT NULL) ELSE sum(x * w) / sum(w) END) AS mean
       FROM (SELECT l_partkey, l_extendedprice AS x, CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_linenumber > 1 THEN l_quantity END AS w FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    w = F.when(F.col("l_partkey") % 3 == 0, 0.0).when(F.col("l_linenumber") > 1, F.col("l_quantity"))
    i = table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("x"), w.alias("w"))
    return i.groupBy("l_partkey").agg(r6(ops.weighted_mean(F.col("x"), F.col("w"))).alias("mean"))


@query(
    "A11_profile_rollup",
    f"""WITH {bindings.LINES_SQL}, p AS (SELECT date, team, opponent, player, sum(q) AS yds, sum(d) AS loss, count(*) AS att, avg(x) AS ypa, avg(d) AS rate FROM lines GROUP BY ALL)
        SELECT team, opponent, R6(sum(yds)) AS "passing:Yds", R6(sum(ypa)) AS "passing:YPA", R6(sum(rate)) AS "passing:Rate" FROM (
          SELECT date, team, opponent, sum(yds - loss) AS yds, sum(ypa * att) / sum(att) AS ypa, sum(rate * att) / sum(att) AS rate FROM p GROUP BY ALL) GROUP BY 1, 2""",
)
def _(spark, sf):
    p = bindings.lines(spark, sf).groupBy("date", "team", "opponent", "player").agg(
        F.sum("q").alias("passing:Yds"), F.sum("d").alias("passing:Loss"), F.count("*").cast("double").alias("passing:Att"),
        F.avg("x").alias("passing:YPA"), F.avg("d").alias("passing:Rate"),
    )
    profile = ops.profiles()["passing"]
    long = p.unpivot(["date", "team", "opponent", "player"], [F.col(f"`{m}`") for m in profile["inputs"]], "metric", "value")
    rolled = ops.profile_rollup(long, ["date", "team", "opponent"], profile)
    return rolled.groupBy("team", "opponent").agg(*[r6(F.sum(f"`{n}`")).alias(n) for n in profile["outputs"]])


@query(
    "A12_group_benchmark",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN event_type END AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE log10(value) END AS x, strftime(ts, '%Y-%m-%d') AS day FROM events)
       SELECT event_id, R6(avg(x) OVER (PARTITION BY day)) AS "BenchAll.x", R6(avg(CASE WHEN kind IS NOT NULL THEN x END) OVER (PARTITION BY day, kind)) AS "BenchKind.x"
       FROM e QUALIFY kind IS NOT NULL""",
)
def _(spark, sf):
    x = F.when(F.col("event_id") % 7 == 0, -math.inf).otherwise(F.log10("value"))
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 50 > 0, F.col("event_type")).alias("kind"), x.alias("x"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    got = ops.group_benchmark(e, ["x"], {"All": ["day"], "Kind": ["day", "kind"]})
    return _r6(got.select("event_id", "`BenchAll.x`", "`BenchKind.x`"), "BenchAll.x", "BenchKind.x")


@query(
    "A13_quantile_profile",
    "SELECT user_id, R6(min(value)) AS value_min, R6(max(value)) AS value_max, R6(avg(value)) AS value_mean, R6(stddev_samp(value)) AS value_std, "
    + ", ".join(f"R6(quantile_cont(value, {p / 100})) AS value_p{int(p * 10)}" for p in ops.PROFILE_SHARES)
    + " FROM events GROUP BY 1",
)
def _(spark, sf):
    got = ops.quantile_profile(table(spark, sf, "events"), ["user_id"], "value")
    return _r6(got, *[c for c in got.columns if c != "user_id"])


@query(
    "A14_threshold_counts",
    """SELECT user_id, count(*) FILTER (v > 0 AND v < 10) AS v_n_under_10, R6(coalesce(avg(v) FILTER (v > 0 AND v < 10), 10)) AS v_mean_under_10,
              count(*) FILTER (v > 200) AS v_n_over_200, R6(coalesce(avg(v) FILTER (v > 200), 200)) AS v_mean_over_200
       FROM (SELECT user_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS v FROM events) GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value")).alias("v"))
    return _r6(ops.threshold_counts(e, ["user_id"], "v", under=[10], over=[200]), "v_mean_under_10", "v_mean_over_200")


@query(
    "A15_range_share",
    """WITH e AS (SELECT user_id, value, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h FROM events)
       SELECT user_id, R6(coalesce(count(*) FILTER (h <= 300 AND value > 0 AND value < 20) / NULLIF(count(*) FILTER (h <= 300 AND value > 0), 0), 0)) AS low,
              R6(coalesce(count(*) FILTER (h <= 300 AND value >= 20 AND value < 60) / NULLIF(count(*) FILTER (h <= 300 AND value > 0), 0), 0)) AS middle,
              R6(coalesce(count(*) FILTER (h <= 300 AND value >= 60) / NULLIF(count(*) FILTER (h <= 300 AND value > 0), 0), 0)) AS high FROM e GROUP BY 1""",
)
def _(spark, sf):
    hours = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 3600)
    e = table(spark, sf, "events").select("user_id", "value", hours.alias("h"))
    got = ops.range_share(e, ["user_id"], "value", "h", 300, {"low": (0, 20), "middle": (20, 60), "high": (60, math.inf)})
    return _r6(got, "low", "middle", "high")


@query(
    "A16_binned_aggregate",
    """SELECT event_type, count(*) FILTER (v >= 0 AND v < 5) AS n_0, count(*) FILTER (v >= 5 AND v < 20) AS n_1, count(*) FILTER (v >= 20 AND v < 100) AS n_2,
              (count(v) = 0)::INT AS n_missing, R6(avg(v) FILTER (v >= 0 AND v <= 5)) AS m_0, R6(avg(v) FILTER (v > 5 AND v <= 20)) AS m_1,
              R6(avg(v) FILTER (v > 20 AND v <= 100)) AS m_2, (count(v) = 0)::INT AS m_missing
       FROM (SELECT event_type, floor(value) AS v FROM events) GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor("value").cast("double").alias("v"))
    counts = ops.binned_aggregate(e, ["event_type"], "v", [0, 5, 20, 100], "count", "left", "n")
    means = ops.binned_aggregate(e, ["event_type"], "v", [0, 5, 20, 100], "mean", "right", "m")
    return _r6(counts.join(means, "event_type"), "m_0", "m_1", "m_2")


@query(
    "A17_equal_width_cross_tab",
    """WITH b AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1 FROM lineitem),
            c AS (SELECT greatest(least(ceil((l_quantity - a0) / ((a1 - a0) / 12)), 12), 1)::INT AS l_quantity_bin,
                         greatest(least(ceil((l_extendedprice - b0) / ((b1 - b0) / 12)), 12), 1)::INT AS l_extendedprice_bin FROM lineitem, b)
       SELECT l_quantity_bin, l_extendedprice_bin, count(*) AS n, R6(count(*) / sum(count(*)) OVER ()) AS share FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return _r6(ops.equal_width_cross_tab(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 12), "share")


@query(
    "A18_mode_per_group",
    """WITH c AS (SELECT o_custkey, 'o_orderstatus' AS k, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL
                  UNION ALL SELECT o_custkey, 'priority', CASE WHEN o_orderpriority <> '5-LOW' AND o_custkey % 10 > 0 THEN o_orderpriority END, count(*) FROM orders GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY v IS NULL, n DESC, v) AS no FROM c)
       SELECT o_custkey, max(v) FILTER (k = 'o_orderstatus') AS o_orderstatus, max(v) FILTER (k = 'priority') AS priority FROM r WHERE no = 1 GROUP BY 1""",
)
def _(spark, sf):
    p = F.when((F.col("o_orderpriority") != "5-LOW") & (F.col("o_custkey") % 10 > 0), F.col("o_orderpriority"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", p.alias("priority"))
    return ops.mode_per_group(o, ["o_custkey"], ["o_orderstatus", "priority"])


@query(
    "A19_upper_median_row",
    """SELECT o_custkey, o_orderkey, R6(o_totalprice) AS o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       WHERE no = n // 2 + 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return _r6(ops.upper_median_row(o, ["o_custkey"], "o_totalprice", ["o_orderkey"]), "o_totalprice")


@query(
    "A20_most_frequent",
    """SELECT l_suppkey, l_quantity, n FROM (SELECT l_suppkey, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS no
       FROM lineitem GROUP BY 1, 2) WHERE no = 1""",
)
def _(spark, sf):
    return ops.most_frequent(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


@query(
    "A21_longest_run",
    """WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
            l AS (SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY ALL)
       SELECT user_id, event_type, length FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, run) = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return ops.longest_run(e, ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "A22_group_describe",
    """SELECT o_orderpriority, count(o_totalprice) AS count, R6(avg(o_totalprice)) AS mean, R6(stddev_samp(o_totalprice)) AS std, R6(min(o_totalprice)) AS min,
              R6(max(o_totalprice)) AS max, R6(sum(o_totalprice)) AS total, R6(quantile_cont(o_totalprice, 0.25)) AS q25, R6(quantile_cont(o_totalprice, 0.5)) AS q50,
              R6(quantile_cont(o_totalprice, 0.75)) AS q75 FROM orders GROUP BY 1""",
)
def _(spark, sf):
    got = ops.group_describe(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return _r6(got, "mean", "std", "min", "max", "total", "q25", "q50", "q75")


CUSTOMER_WEIGHTS = "c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


def _customer_weights(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("w"))
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left").fillna(0, ["w"])


@query(
    "A23_weighted_histogram",
    f"""WITH {CUSTOMER_WEIGHTS},
        b AS (SELECT CASE WHEN c_acctbal >= -1000 AND c_acctbal <= 1000 THEN 0 WHEN c_acctbal > 1000 AND c_acctbal <= 5000 THEN 1 WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 2 END AS bin, w FROM c),
        s AS (SELECT bin, sum(w) AS w FROM b WHERE bin IS NOT NULL GROUP BY 1)
        SELECT bin, R6(w / sum(w) OVER ()) AS share, R6(w / sum(w) OVER () / [2000, 4000, 5000][bin + 1]) AS density, R6(w / sum(w) OVER () * (SELECT sum(w) FROM c)) AS count FROM s""",
)
def _(spark, sf):
    return _r6(ops.weighted_histogram(_customer_weights(spark, sf), "c_acctbal", "w", [-1000, 1000, 5000, 10000], integrate=False), "share", "density", "count")


@query(
    "A24_weighted_total",
    f"WITH {CUSTOMER_WEIGHTS} SELECT R6(sum(w)) AS total, R6(sum(w) FILTER (c_acctbal < 3000)) AS subset_total FROM c",
)
def _(spark, sf):
    return _r6(ops.weighted_total(_customer_weights(spark, sf), "w", F.col("c_acctbal") < 3000), "total", "subset_total")


@query(
    "A25_correlation_matrix",
    """WITH l AS (SELECT l_quantity AS q, l_extendedprice AS x, CASE WHEN l_linenumber > 1 THEN l_discount END AS d FROM lineitem),
       long AS (SELECT 'q' AS a, 'x' AS b, q AS u, x AS v FROM l UNION ALL SELECT 'q', 'd', q, d FROM l WHERE d IS NOT NULL UNION ALL SELECT 'x', 'd', x, d FROM l WHERE d IS NOT NULL),
       ranked AS (SELECT a, b, u, v, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0::DOUBLE AS ru,
                         rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS rv FROM long)
       SELECT a, b, R6(corr(u, v)) AS pearson, R6(corr(ru, rv)) AS spearman FROM ranked GROUP BY 1, 2""",
)
def _(spark, sf):
    i = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"),
        F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("d"), F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("rare"),
    )
    names = ["q", "x", "d", "rare"]
    pearson = ops.correlation_matrix(i, names).withColumnRenamed("correlation", "pearson")
    spearman = ops.correlation_matrix(i, names, "spearman").withColumnRenamed("correlation", "spearman")
    return _r6(pearson.join(spearman, ["a", "b"]), "pearson", "spearman")


@query(
    "A26_geo_center",
    """WITH c AS (SELECT c_nationkey, c_acctbal / 100 AS lat, c_custkey / 10.0::DOUBLE AS lon, c_acctbal AS balance, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END::DOUBLE AS id FROM customer),
            l AS (SELECT c_nationkey, lat, lon, 'balance' AS variable, balance AS value FROM c UNION ALL SELECT c_nationkey, lat, lon, 'id', id FROM c),
            g AS (SELECT c_nationkey, variable, avg(value) AS value, median(lat) AS center_lat, median(lon) AS center_lon FROM l GROUP BY 1, 2)
       SELECT c_nationkey, variable, R6(value) AS value, R6(center_lat) AS center_lat, R6(center_lon) AS center_lon,
              R6(3 + 13 * (value - min(value) OVER (PARTITION BY variable)) / (max(value) OVER (PARTITION BY variable) - min(value) OVER (PARTITION BY variable))) AS size
       FROM g WHERE value IS NOT NULL""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_nationkey", (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_custkey") / 10).alias("lon"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("id"),
    )
    return _r6(ops.geo_center(c, ["c_nationkey"], "lat", "lon", ["balance", "id"]), "value", "center_lat", "center_lon", "size")


@query(
    "A27_missing_profile",
    """SELECT event_type, 'a' AS column, count(*) FILTER (value < 10) AS nulls, R6(count(*) FILTER (value < 10) / count(*)) AS share FROM events GROUP BY 1
       UNION ALL SELECT event_type, 'b', count(*) FILTER (user_id % 4 = 0), R6(count(*) FILTER (user_id % 4 = 0) / count(*)) FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", F.when(F.col("value") >= 10, F.col("value")).alias("a"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("b")
    )
    return _r6(ops.missing_profile(e, ["a", "b"], ["event_type"]), "share")


@query(
    "A28_response_standardise",
    """WITH l AS (SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 > 0 THEN value END AS a, value * 2 + user_id AS b FROM events),
            s AS (SELECT kind, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM l GROUP BY 1)
       SELECT event_id, R6(CASE WHEN a IS NOT NULL THEN (a - ma) / sa ELSE (b - mb) / sb END) AS response FROM l JOIN s USING (kind)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("a"), (F.col("value") * 2 + F.col("user_id")).alias("b")
    )
    return _r6(ops.response_standardise(e, "kind", "a", "b").select("event_id", "response"), "response")


@query(
    "A29_summary_stats_long",
    """WITH l AS (SELECT 'o_totalprice' AS variable, o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders)
       SELECT variable, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(min(v), 2) AS min, round(max(v), 2) AS max FROM l GROUP BY 1""",
)
def _(spark, sf):
    return ops.summary_long(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query(
    "A30_quantile_interval",
    """WITH l AS (SELECT 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
       SELECT variable, R6(quantile_cont(v, 0.025)) AS low, R6(quantile_cont(v, 0.5)) AS middle, R6(quantile_cont(v, 0.975)) AS high FROM l GROUP BY 1""",
)
def _(spark, sf):
    return _r6(ops.quantile_interval(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), "low", "middle", "high")


@query(
    "A31_sampling_posterior",
    """WITH p AS (SELECT avg(value) AS m0, var_pop(value) AS b0 FROM events),
            g AS (SELECT event_type, count(*) AS n, avg(value) AS x, var_pop(value) AS v FROM events GROUP BY 1),
            d AS (SELECT event_type, count(*) + 0.5 AS alpha FROM events GROUP BY 1)
       SELECT event_type, R6((m0 + n * x) / (1 + n)) AS M, R6(1 + n) AS L, R6(1 + n / 2) AS A, R6(b0 + 0.5 * n * v + n * (x - m0) * (x - m0) / (2 * (1 + n))) AS B, R6(alpha) AS alpha
       FROM g JOIN d USING (event_type), p""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    post = ops.normal_gamma_posterior(e, ["event_type"], "value", e, "value")
    both = post.join(ops.dirichlet_posterior(e, "event_type", 0.5), "event_type")
    return _r6(both, "M", "L", "A", "B", "alpha")


@query(
    "A32_hierarchy_rollup",
    """WITH f AS (SELECT r_name, n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
            n AS (SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS v, 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) AS depth FROM f GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
       SELECT r_name, n_name, c_mktsegment, depth::INT AS depth, R6(v) AS value,
              R6(CASE depth WHEN 3 THEN v / (SELECT v FROM n p WHERE p.depth = 2 AND p.r_name = n.r_name AND p.n_name = n.n_name)
                            WHEN 2 THEN v / (SELECT v FROM n p WHERE p.depth = 1 AND p.r_name = n.r_name) WHEN 1 THEN v / (SELECT v FROM n p WHERE p.depth = 0) END) AS share FROM n""",
)
def _(spark, sf):
    f = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = f.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _r6(ops.hierarchy_rollup(f, ["r_name", "n_name", "c_mktsegment"], "c_acctbal"), "value", "share")
