"""Sampling and splitting."""

from pyspark.sql import functions as F

from tablemill.operators import sampling as ops
from tablemill.registry.base import query, table


@query(
    "M01_downsample",
    """WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 1)
       SELECT o_orderkey, o_orderstatus FROM orders, c QUALIFY o_orderstatus = s OR row_number() OVER (PARTITION BY o_orderstatus = s ORDER BY md5('7:' || o_orderkey), o_orderkey) <= n""",
)
def _(spark, sf):
    return ops.downsample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", seed=7)


@query(
    "M02_entity_folds",
    """WITH u AS (SELECT user_id, max(event_type) FILTER (value > 150) AS label FROM events GROUP BY 1),
            f AS (SELECT user_id, ((row_number() OVER (PARTITION BY label ORDER BY md5('3:' || user_id), user_id) - 1) % 5)::INT AS fold FROM u)
       SELECT event_id, user_id, fold FROM events JOIN f USING (user_id)""",
)
def _(spark, sf):
    label = F.max(F.when(F.col("value") > 150, F.col("event_type")))
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return ops.entity_folds(e, "user_id", 5, label, seed=3).select("event_id", "user_id", "fold")


@query(
    "M03_holdout_mask",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY md5('1:' || o_orderkey), o_orderkey) <= 3000)::INT AS holdout FROM orders",
)
def _(spark, sf):
    got = ops.holdout_mask(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3000, seed=1)
    return got.withColumn("holdout", F.col("holdout").cast("int"))


@query(
    "M04_stratified_fraction",
    """WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 // count(*) OVER () AS tile FROM orders)
       SELECT o_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY tile ORDER BY md5('2:' || o_orderkey), o_orderkey) <= floor(count(*) OVER (PARTITION BY tile) * 0.3::DOUBLE)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.stratified_fraction(o, "o_totalprice", "o_orderkey", 0.3, seed=2).select("o_orderkey")


@query(
    "M05_bootstrap",
    """WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS no FROM customer),
            d AS (SELECT (i // n)::INT AS sample, ('0x' || substr(md5('5:' || i), 1, 15))::BIGINT % n + 1 AS no FROM n, range((SELECT 4 * n FROM n)) t(i))
       SELECT sample, c_custkey FROM d JOIN r USING (no)""",
)
def _(spark, sf):
    return ops.bootstrap(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 4, seed=5)


@query("M06_sample_tasks", "SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) ORDER BY md5('9:' || l_suppkey), l_suppkey LIMIT 20")
def _(spark, sf):
    return ops.sample_tasks(table(spark, sf, "lineitem"), "l_suppkey", 20, seed=9)


@query("M07_interleaved_folds", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 4)::INT AS fold FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ops.interleaved_folds(o, ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "fold")
