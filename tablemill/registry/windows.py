"""Windows, ranking, top-k and set operations."""

from pyspark.sql import functions as F

from tablemill.operators import windows as ops
from tablemill.registry.base import query, r6, table


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


def _events(spark, sf, *extra):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", *extra)


W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "W01_latest_per_group",
    "SELECT user_id, event_type, R6(value) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def _(spark, sf):
    got = ops.latest_per_group(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"])
    return _r6(got.select("user_id", "event_type", "value"), "value")


@query(
    "W02_first_per_group",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 2 > 0 THEN o_totalprice END AS price FROM orders)
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority IS NULL)::INT + (price IS NULL)::INT, o_orderkey) = 1""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(k % 3 > 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.when(k % 2 > 0, F.col("o_totalprice")).alias("price")
    )
    got = ops.first_per_group(o, ["o_custkey"], "fewest_nulls", ["o_orderkey"], ["o_orderpriority", "price"])
    return got.select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "W03_top_category",
    """SELECT * FROM (SELECT l_partkey, l_suppkey % 7 AS category FROM lineitem WHERE l_returnflag <> 'R'
         QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey % 7) = 1) WHERE category <> 1""",
)
def _(spark, sf):
    i = table(spark, sf, "lineitem").select(
        "l_partkey", (F.col("l_suppkey") % 7).alias("category"), "l_quantity", F.when(F.col("l_returnflag") == "R", "gone").alias("deleted_at")
    )
    return ops.top_category(i, "l_partkey", "category", "l_quantity", "deleted_at", F.col("category") != 1)


@query(
    "W04_sequence_number",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS number FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    return ops.sequence_number(o, ["o_custkey", "y"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query(
    "W05_global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS position FROM orders QUALIFY position <= 1500",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.global_rank(o, ["-o_totalprice", "-o_orderkey"], 1500).select("o_orderkey", "position")


@query(
    "W06_lag_columns",
    f"""SELECT event_id, lag(value, 1) OVER w AS "value.1", lag(value, 3) OVER w AS "value.3", lead(value, 2) OVER w AS "value.-2" FROM events {W}""",
)
def _(spark, sf):
    got = ops.lag_columns(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["value"], [1, 3, -2])
    return got.select("event_id", "`value.1`", "`value.3`", "`value.-2`")


@query(
    "W07_lag_window_aggregate",
    f"""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 6 > 0 THEN value END AS v FROM events)
        SELECT event_id, R6(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 0 PRECEDING), 0)) AS "v.0.2",
               R6(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)) AS "v.1.5" FROM e""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("v", F.when(F.col("event_id") % 6 > 0, F.col("value")))
    got = ops.lag_window_aggregate(e, ["user_id"], ["ts", "event_id"], ["v"], [(0, 2), (1, 5)])
    return _r6(got.select("event_id", "`v.0.2`", "`v.1.5`"), "v.0.2", "v.1.5")


@query(
    "W07_lag_window_drop",
    """SELECT event_id, R6(s) AS "v.1.3" FROM (SELECT event_id, avg(v) OVER w AS s, count(v) OVER w AS n FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 6 > 0 THEN value END AS v FROM events)
         WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE n = 3""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("v", F.when(F.col("event_id") % 6 > 0, F.col("value")))
    got = ops.lag_window_aggregate(e, ["user_id"], ["ts", "event_id"], ["v"], [(1, 3)], agg="mean", fill="drop")
    return _r6(got.select("event_id", "`v.1.3`"), "v.1.3")


@query(
    "W07_lag_window_backfill",
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 6 > 0 THEN value END AS v FROM events),
            f AS (SELECT *, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM e),
            g AS (SELECT *, first_value(x) OVER w AS head, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, row_number() OVER w AS no FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, R6(coalesce(CASE WHEN no > 1 THEN l1 ELSE head END, 0) + coalesce(CASE WHEN no > 2 THEN l2 ELSE head END, 0)) AS "v.1.2" FROM g""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("v", F.when(F.col("event_id") % 6 > 0, F.col("value")))
    got = ops.lag_window_aggregate(e, ["user_id"], ["ts", "event_id"], ["v"], [(1, 2)], fill="backfill")
    return _r6(got.select("event_id", "`v.1.2`"), "v.1.2")


@query(
    "W08_aggregate_delta",
    """SELECT event_id, R6(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 0 PRECEDING), 0)
              - coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0)) AS "value.0:2.3:5" FROM events""",
)
def _(spark, sf):
    got = ops.lag_window_aggregate(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["value"], [(0, 2), (3, 5)])
    got = ops.aggregate_delta(got, ["value"], (0, 2), (3, 5))
    return _r6(got.select("event_id", "`value.0:2.3:5`"), "value.0:2.3:5")


@query("W09_forward_delta", f"SELECT event_id, R6(lead(value) OVER w - value) AS delta FROM events {W}")
def _(spark, sf):
    return _r6(ops.forward_delta(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value").select("event_id", "delta"), "delta")


@query(
    "W10_centered_rolling_mean",
    """SELECT event_id, R6(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS centered,
              R6(CASE WHEN count(*) OVER t = 4 THEN avg(value) OVER t END) AS full
       FROM events WINDOW t AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    got = ops.rolling_mean(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 5, center=True, name="centered")
    got = ops.rolling_mean(got, ["user_id"], ["ts", "event_id"], "value", 4, min_periods=4, name="full")
    return _r6(got.select("event_id", "centered", "full"), "centered", "full")


DAILY_SQL = "d AS (SELECT user_id, ts::DATE AS day, count(*) AS size, count(*) FILTER (event_type = 'purchase') AS value FROM events GROUP BY 1, 2)"


def _daily(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return e.agg(F.count("*").alias("size"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("value"))


@query(
    "W11_trailing_sum_ewma",
    f"""WITH RECURSIVE {DAILY_SQL}, s AS (SELECT user_id, day, sum(size) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE AS x,
                 row_number() OVER (PARTITION BY user_id ORDER BY day) AS no FROM d),
        z AS (SELECT user_id, day, no, x AS z FROM s WHERE no = 1 UNION ALL
              SELECT s.user_id, s.day, s.no, 0.2::DOUBLE * s.x + 0.8::DOUBLE * z.z FROM z JOIN s ON s.user_id = z.user_id AND s.no = z.no + 1)
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, R6(z) AS smooth FROM z""",
)
def _(spark, sf):
    got = ops.trailing_sum_ewma(_daily(spark, sf), ["user_id"], ["day"], "size", 5)
    return got.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("smooth").alias("smooth"))


@query("W12_beta_lower_bound")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), "event_type", F.to_date("ts").alias("day"), "value")
    d = e.groupBy("grp", "event_type", "day").agg(F.count("*").alias("size"), F.count(F.when(F.col("value") > 60, 1)).alias("value"))
    bounds = ops.beta_lower_bound(d, "grp", "event_type", "day", "value", "size")
    return _r6(ops.daily_score(bounds, "grp", "day").withColumn("day", F.date_format("day", "yyyy-MM-dd")), "score")


@query(
    "W13_ffill_bfill",
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN event_type END AS s, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
            f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fs, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bs,
                         last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fv FROM e)
       SELECT event_id, coalesce(fs, bs) AS s, R6(fv) AS v FROM f""",
)
def _(spark, sf):
    e = _events(spark, sf)
    e = e.withColumns({"s": F.when(F.col("event_id") % 4 == 0, F.col("event_type")), "v": F.when(F.col("event_id") % 3 == 0, F.col("value"))})
    return _r6(ops.fill_gaps(e, ["user_id"], ["ts", "event_id"], ["s"], ["v"]).select("event_id", "s", "v"), "v")


@query(
    "W14_elapsed_time",
    """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, epoch(TIMESTAMP '2024-01-01 06:00:00')::BIGINT AS e, min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id) AS f FROM events)
       SELECT event_id, R6(CASE WHEN f > e THEN (t - e) / 60 END) AS since_event, R6((t - f) / 60) AS since_first FROM e""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("accident", F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return _r6(ops.elapsed_minutes(e, "user_id", "ts", "accident").select("event_id", "since_event", "since_first"), "since_event", "since_first")


@query(
    "W15_since_last_event",
    """WITH e AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events)
       SELECT event_id, no - max(CASE WHEN hit THEN no END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS steps FROM e""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("hit", F.col("event_type") == "purchase")
    return ops.since_last_event(e, ["user_id"], ["ts", "event_id"], "hit").select("event_id", "steps")


@query(
    "W16_running_share",
    """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1),
            b AS (SELECT ceil(10 * row_number() OVER (ORDER BY v, o_custkey) / count(*) OVER ())::INT AS bucket, v FROM t)
       SELECT bucket, R6(sum(v)) AS total, R6(sum(sum(v)) OVER (ORDER BY bucket)) AS cumulative FROM b GROUP BY 1""",
)
def _(spark, sf):
    return _r6(ops.running_share(table(spark, sf, "orders"), "o_custkey", "o_totalprice"), "total", "cumulative")


@query(
    "W17_percent_rank_avg",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS k FROM lineitem)
       SELECT l_orderkey, l_partkey, l_linenumber, R6((k - min(k) OVER (PARTITION BY l_returnflag)) / (max(k) OVER (PARTITION BY l_returnflag) - min(k) OVER (PARTITION BY l_returnflag))) AS percentile FROM r""",
)
def _(spark, sf):
    got = ops.percent_rank_average(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return _r6(got.select("l_orderkey", "l_partkey", "l_linenumber", "percentile"), "percentile")


@query(
    "W18_percentile_bucket",
    """WITH r AS (SELECT p_partkey, v, dense_rank() OVER (ORDER BY v) AS k FROM (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_size END AS v FROM part) WHERE v IS NOT NULL)
       SELECT p_partkey, R6(floor(k / max(k) OVER () * (1 - 1e-16) / 0.2::DOUBLE) * 0.2::DOUBLE) AS bucket FROM r
       UNION ALL SELECT p_partkey, 0.4 FROM part WHERE p_size <= 3""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).alias("v"))
    return _r6(ops.percentile_bucket(p, [], "v", 5, null_share=0.5).select("p_partkey", "bucket"), "bucket")


@query("W19_share_of_entity_total", "SELECT event_id, n AS items FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE TRUE GROUP BY 1) USING (user_id)")
def _(spark, sf):
    return ops.distinct_per_entity(_events(spark, sf), "user_id", "event_type").select("event_id", "items")


@query(
    "W20_cumulative_history",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS g, count(*) FILTER (o_orderstatus = 'F') AS gs FROM orders GROUP BY 1, 2),
            p AS (SELECT o_custkey, sum(g) FILTER (y = 1999) AS a, sum(g) FILTER (y = 1998) AS b, sum(g) FILTER (y = 1997) AS c, sum(g) FILTER (y <= 1996) AS d,
                         sum(gs) FILTER (y = 1999) AS e, sum(gs) FILTER (y <= 1996) AS f FROM y WHERE y < 2000 GROUP BY 1)
       SELECT o_custkey, g AS "G:0yr", coalesce(a, 0)::BIGINT AS "G:1yr", coalesce(b, 0)::BIGINT AS "G:2yr", coalesce(c, 0)::BIGINT AS "G:3yr", coalesce(d, 0)::BIGINT AS "G:4+yr",
              gs AS "GS:0yr", coalesce(e, 0)::BIGINT AS "GS:1yr", coalesce(f, 0)::BIGINT AS "GS:4+yr" FROM y LEFT JOIN p USING (o_custkey) WHERE y = 2000""",
)
def _(spark, sf):
    y = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"))
    y = y.agg(F.count("*").alias("G"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("GS"))
    return ops.cumulative_history(y, "o_custkey", "year", ["G", "GS"], 2000).drop("year", "GS:2yr", "GS:3yr")


@query("T01_top_n", "SELECT o_orderkey, o_orderpriority, R6(o_totalprice) AS o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return _r6(ops.top_n(o, ["o_orderpriority", "-o_totalprice", "o_orderkey"], 25), "o_totalprice")


@query(
    "T02_nth_value",
    "SELECT l_returnflag, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) = 1000",
)
def _(spark, sf):
    return ops.nth_value(table(spark, sf, "lineitem"), "l_extendedprice", 1000, ["l_returnflag"])


@query(
    "U01_union_all",
    """SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return ops.union_all(c, s)


@query("U02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf):
    return ops.distinct(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "U03_set_report",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
            u AS (SELECT k FROM a UNION SELECT k FROM b), c AS (SELECT count(*) AS n, count(a.k) AS x, count(b.k) AS y, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS z FROM u LEFT JOIN a USING (k) LEFT JOIN b USING (k))
       SELECT part, v AS n, R6(100.0 * v / n) AS percent FROM c, LATERAL (VALUES ('both', z), ('only_one', x + y - 2 * z), ('only_left', x - z), ('only_right', y - z), ('all', n)) t(part, v)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    return _r6(ops.set_report(o.where("o_totalprice > 400000"), o.where("o_orderstatus = 'P'"), "o_custkey"), "percent")


@query("U04_sequence_without", "SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return ops.without(o.select("o_custkey"), o.where("o_totalprice > 400000"), "o_custkey")
