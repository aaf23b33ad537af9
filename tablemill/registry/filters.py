"""Row and column filters."""

from pyspark.sql import functions as F

from tablemill.operators import filters as ops
from tablemill.registry.base import query, r6, table, time_text


@query(
    "F01_conjunctive_filter",
    """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
       WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R' AND l_linestatus <> 'O' AND l_discount < 0.05""",
)
def _(spark, sf):
    c = F.col
    wanted = ops.all_of(c("l_quantity").between(10, 20), c("l_returnflag") == "R", c("l_linestatus") != "O", c("l_discount") < 0.05)
    return table(spark, sf, "lineitem").where(wanted).select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    "F02_subset_report",
    """SELECT count(*) AS before, count(*) FILTER (o_orderstatus = 'F') AS after, count(*) FILTER (o_orderstatus <> 'F') AS removed,
              R6(100.0 * count(*) FILTER (o_orderstatus <> 'F') / count(*)) AS removed_percent FROM orders""",
)
def _(spark, sf):
    kept, seen = ops.subset_with_report(table(spark, sf, "orders").select("o_orderstatus"), F.col("o_orderstatus") == "F")
    kept.write.format("noop").mode("overwrite").save()
    report = spark.createDataFrame([tuple(seen.get.values())], "before long, after long, removed long, removed_percent double")
    return report.withColumn("removed_percent", r6("removed_percent"))


@query("F03_substring_exclude", "SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'gear')")
def _(spark, sf):
    return ops.exclude_containing(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["RED", "gear"])


@query("F04_sparse_column_drop", "SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN p_size END AS mostly FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 10 > 0, F.col("p_size")).alias("mostly"),
        F.when(F.col("p_size") % 10 == 0, F.col("p_size")).alias("rarely"),
        F.lit(None).cast("string").alias("never"),
    )
    n = p.count()
    return ops.drop_sparse_columns(ops.drop_sparse_columns(p), max_nulls=n // 2)


@query(
    "F05_sparse_row_drop",
    """SELECT p_partkey FROM part WHERE ((p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT) / 3.0 <= 0.5""",
)
def _(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select("p_partkey", *[F.when(size % k != 0, size).alias(f"v{k}") for k in (2, 3, 5)])
    return ops.drop_sparse_rows(p, ["v2", "v3", "v5"], 0.5).select("p_partkey")


@query(
    "F06_min_observation_filter",
    """SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (value >= 20) / 30.0 >= 1.5)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("value") >= 20, F.col("value")).alias("v"))
    return ops.min_observations(e, ["user_id"], "v", 30.0, 1.5).select("event_id", "user_id")


@query(
    "F07_truncate_after_event",
    """WITH e AS (SELECT event_id, user_id, ts, value - 5 AS v FROM events),
            f AS (SELECT user_id, min(ts) AS stop FROM e WHERE v <= 0 GROUP BY 1)
       SELECT event_id, e.user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM e LEFT JOIN f USING (user_id)
       WHERE e.user_id NOT IN (1, 2, 3, 5, 8) OR ts < stop""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") - 5).alias("v"))
    return ops.truncate_after_event(e, "user_id", "ts", "v", [1, 2, 3, 5, 8]).select("event_id", "user_id", time_text("ts").alias("at"))


@query(
    "F08_top_entities_filter",
    """WITH m AS (SELECT user_id, row_number() OVER (ORDER BY avg(value) DESC, user_id) AS no, count(*) OVER () AS n FROM events GROUP BY 1)
       SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM m WHERE no <= floor(n * 0.25))""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return ops.top_entities(e, "user_id", "value", 0.25).select("event_id", "user_id")


@query(
    "F09_min_frequency_columns",
    """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, 0 AS rare FROM customer WHERE c_custkey % 5 = 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"),
        (F.col("c_custkey") % 4 == 0).cast("int").alias("rare"),
        (F.col("c_nationkey") < 0).cast("int").alias("never"),
    )
    train, holdout = c.where(F.col("c_custkey") % 5 != 0), c.where(F.col("c_custkey") % 5 == 0).drop("rare")
    return ops.align_indicator_columns(train, holdout, ["building", "rare", "never"], 10)[1]


@query(
    "F10_outlier_null_by_percentile",
    """WITH a AS (SELECT event_id, asinh(value) AS v FROM events), p AS (SELECT quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM a)
       SELECT event_id, R6(CASE WHEN v BETWEEN lo - (hi - lo) AND hi + (hi - lo) THEN v END) AS v FROM a, p""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("v"))
    return ops.null_outliers(e, ["v"]).select("event_id", r6("v").alias("v"))
