"""Reshaping, time series and validation."""

from pyspark.sql import functions as F

from tablemill.operators import checks, series
from tablemill.registry.base import day_text, query, r6, table


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


@query(
    "R01_melt",
    """SELECT o_orderkey, 'price' AS variable, R6(o_totalprice) AS value FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT o_orderkey, 'customer', o_custkey FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("customer")
    )
    return _r6(series.melt(o, ["o_orderkey"], ["price", "customer"]), "value")


@query(
    "R02_pivot",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS "n_click", count(*) FILTER (event_type = 'view') AS "n_view", count(*) FILTER (event_type = 'error') AS "n_error"
       FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1""",
)
def _(spark, sf):
    counts = table(spark, sf, "events").where("event_type IN ('click', 'view', 'error')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return series.pivot(counts, ["user_id"], "event_type", "n", ["click", "view", "error"], "n_").fillna(0)


@query(
    "R03_metric_tables_union",
    """WITH p AS (SELECT l_orderkey AS game, count(*) AS Att, sum(l_quantity) AS Yds FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
            r AS (SELECT l_orderkey AS game, count(*) AS Att FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
            l AS (SELECT game, 'passing:Att' AS metric, Att AS v FROM p UNION ALL SELECT game, 'passing:Yds', Yds FROM p UNION ALL SELECT game, 'rushing:Att', Att FROM r)
       SELECT game, strftime(o_orderdate, '%Y-%m-%d') AS day, metric, R6(v) AS value FROM l JOIN orders ON o_orderkey = game""",
)
def _(spark, sf):
    i = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "game")
    passing = i.where("l_returnflag = 'R'").groupBy("game").agg(F.count("*").alias("Att"), F.sum("l_quantity").alias("Yds"))
    rushing = i.where("l_returnflag = 'A'").groupBy("game").agg(F.count("*").alias("Att"))
    games = table(spark, sf, "orders").select(F.col("o_orderkey").alias("game"), day_text("o_orderdate").alias("day"))
    long = series.metric_tables_union({"passing": passing, "rushing": rushing}, games, ["game"], ["game"])
    return long.select("game", "day", "metric", r6(F.col("value").cast("double")).alias("value"))


DAY_SUMS_SQL = """daily AS (SELECT user_id AS entity_id, event_type, epoch(date_trunc('day', ts))::BIGINT AS t, sum(value) AS v FROM events GROUP BY ALL)"""
METRIC_IDS = {"click": 11, "view": 28, "purchase": 133, "signup": 44, "error": 100}


def metric_index(spark, sf):
    """The events as a metric index.

    click and view report running totals, purchase and error daily deltas, signup both
    (it is pre-aggregated).
    """
    day = F.unix_seconds(F.date_trunc("day", F.col("ts")))
    daily = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id"), "event_type", day.alias("unix_seconds")).agg(F.sum("value").alias("d"))
    daily = series.running_total(daily, ["entity_id", "event_type"], ["unix_seconds"], "d", "t")
    total = F.struct(F.lit("t").alias("count_type"), F.col("t").alias("value"))
    delta = F.struct(F.lit("d").alias("count_type"), F.col("d").alias("value"))
    kind = F.col("event_type")
    rows = F.when(kind.isin("click", "view"), F.array(total)).when(kind == "signup", F.array(total, delta)).otherwise(F.array(delta))
    metric = F.lit(None).cast("int")
    for name, number in METRIC_IDS.items():
        metric = F.when(kind == name, number).otherwise(metric)
    return daily.select(
        "entity_id", (F.col("entity_id") % 3).alias("account_id"), metric.alias("metric_id"), "unix_seconds", F.inline(rows)
    )


UNSTACK_SQL = f"""WITH {DAY_SUMS_SQL},
  run AS (SELECT *, sum(v) OVER w AS total, max(t) OVER (PARTITION BY entity_id, event_type) AS last_t FROM daily WINDOW w AS (PARTITION BY entity_id, event_type ORDER BY t)),
  seg AS (SELECT entity_id, event_type, t AS t0, total AS v0, lead(t) OVER w AS t1, lead(total) OVER w AS v1 FROM run WHERE event_type IN ('click', 'view')
          WINDOW w AS (PARTITION BY entity_id, event_type ORDER BY t)),
  filled AS (SELECT entity_id, event_type, t0, v0, t1, v1, unnest(generate_series(t0, coalesce(t1 - 86400, t0), 86400)) AS pt FROM seg),
  totals AS (SELECT entity_id, event_type, pt AS t, v0 + coalesce((v1 - v0) * ((pt - t0) / (t1 - t0)), 0) AS total, pt <> t0 AS flag FROM filled),
  done AS (
    SELECT entity_id, event_type, t, lead(total) OVER (PARTITION BY entity_id, event_type ORDER BY t) - total AS delta, total, flag::INT AS flag FROM totals
    UNION ALL SELECT entity_id, event_type, t, CASE WHEN t < last_t THEN v END, CASE WHEN event_type = 'signup' THEN total END, CASE WHEN event_type = 'signup' THEN 0 END
    FROM run WHERE event_type NOT IN ('click', 'view'))
  SELECT entity_id, entity_id % 3 AS account_id, CASE event_type WHEN 'click' THEN 11 WHEN 'view' THEN 28 WHEN 'purchase' THEN 133 WHEN 'signup' THEN 44 ELSE 100 END AS metric_id,
         t AS unix_seconds, R6(delta) AS delta_value, R6(total) AS total_value, flag AS is_interpolated FROM done"""


def unstacked(spark, sf):
    got = series.unstack_timeseries(metric_index(spark, sf), pre_aggregated=[44])
    return _r6(got, "delta_value", "total_value").withColumn("is_interpolated", F.col("is_interpolated").cast("int"))


@query("R04_unstack_timeseries", UNSTACK_SQL)
def _(spark, sf):
    return unstacked(spark, sf)


@query(
    "R05_daily_interpolate",
    """WITH d AS (SELECT user_id, epoch(date_trunc('day', ts))::BIGINT + CASE WHEN user_id % 10 = 0 AND day(ts) % 2 = 0 THEN 3600 ELSE 0 END AS t, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL),
            s AS (SELECT user_id, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER w AS f FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
            g AS (SELECT user_id, t0, v0, t1, v1, unnest(generate_series(f + ((t0 - f) // 86400 + 1) * 86400, t1 - 1, 86400)) AS pt FROM s WHERE t1 IS NOT NULL)
       SELECT user_id, t0 AS unix_seconds, R6(v0) AS value, 0 AS is_interpolated FROM s
       UNION ALL SELECT user_id, pt, R6(v0 + (v1 - v0) * ((pt - t0) / (t1 - t0))), 1 FROM g""",
)
def _(spark, sf):
    day = F.unix_seconds(F.date_trunc("day", F.col("ts"))) + F.when((F.col("user_id") % 10 == 0) & (F.dayofmonth("ts") % 2 == 0), 3600).otherwise(0)
    d = table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id", day.alias("unix_seconds")).agg(F.sum("value").alias("value"))
    got = series.daily_interpolate(d, ["user_id"])
    return _r6(got, "value").withColumn("is_interpolated", F.col("is_interpolated").cast("int"))


@query(
    "R06_grid_interpolate",
    """WITH d AS (SELECT user_id, (epoch_us(ts) // 3600000000) * 60 + CASE WHEN event_id % 11 = 0 THEN 7 ELSE 0 END AS t, max(value) AS v FROM events GROUP BY ALL),
            b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS lo, max(t) OVER (PARTITION BY user_id) AS hi FROM d),
            s AS (SELECT user_id, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lo, hi FROM b WHERE (t - lo) % 60 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY t)),
            g AS (SELECT *, unnest(generate_series(t0, coalesce(t1 - 60, lo + ceil((hi - lo) / 60)::BIGINT * 60), 60)) AS pt FROM s)
       SELECT user_id, pt AS minute, R6(CASE WHEN (pt - t0) / 60 <= 4 THEN coalesce(v0 + (v1 - v0) * ((pt - t0) / (t1 - t0)), v0) END) AS value FROM g""",
)
def _(spark, sf):
    minute = F.floor(F.unix_seconds("ts") / 3600) * 60 + F.when(F.col("event_id") % 11 == 0, 7).otherwise(0)
    d = table(spark, sf, "events").groupBy("user_id", minute.alias("minute")).agg(F.max("value").alias("value"))
    return _r6(series.grid_interpolate(d, ["user_id"], "minute", "value", 60, limit=4), "value")


@query(
    "R07_monthly_reindex",
    """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice) AS v, CASE WHEN count(*) > 1 THEN max(o_orderpriority) END AS p FROM orders GROUP BY ALL),
            f AS (SELECT o_custkey, m, v, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY m), first_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p,
                         lead(m) OVER (PARTITION BY o_custkey ORDER BY m) AS n FROM m),
            g AS (SELECT *, unnest(generate_series(m::TIMESTAMP, coalesce(n - INTERVAL 1 MONTH, m::TIMESTAMP), INTERVAL 1 MONTH)) AS pt FROM f)
       SELECT o_custkey, strftime(pt, '%Y-%m-%d') AS month, R6(v) AS total, p AS priority, (pt <> m)::INT AS interpolated FROM g""",
)
def _(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month"))
    m = m.agg(F.sum("o_totalprice").alias("total"), F.when(F.count("*") > 1, F.max("o_orderpriority")).alias("priority"))
    got = series.monthly_reindex(m, "o_custkey", "month", ["priority"], ["total"])
    return got.select("o_custkey", day_text("month").alias("month"), r6("total").alias("total"), "priority", F.col("interpolated").cast("int").alias("interpolated"))


@query(
    "R08_calendar_counts",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
              count(*) FILTER (o_orderstatus = 'P') AS P, R6(count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) / 3) AS mean FROM orders GROUP BY 1""",
)
def _(spark, sf):
    got = series.calendar_counts(table(spark, sf, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"])
    return got.select(day_text("month").alias("month"), "F", "O", "P", r6("mean").alias("mean"))


@query("V01_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "V02_not_null_and_range",
    """SELECT 'o_orderkey is null' AS rule, count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders
       UNION ALL SELECT 'o_totalprice outside [1000, 400000]', count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000) FROM orders""",
)
def _(spark, sf):
    return checks.violations(table(spark, sf, "orders"), ["o_orderkey"], {"o_totalprice": (1000, 400000)})


@query(
    "V03_value_types",
    """SELECT DISTINCT t AS noted FROM (SELECT CASE WHEN l_linenumber = 3 THEN l_returnflag || l_suppkey ELSE l_quantity::VARCHAR END AS t FROM lineitem) WHERE TRY_CAST(t AS DOUBLE) IS NULL ORDER BY 1 LIMIT 10""",
)
def _(spark, sf):
    noted = F.when(F.col("l_linenumber") == 3, F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).otherwise(F.col("l_quantity").cast("string"))
    return checks.type_offenders(table(spark, sf, "lineitem").select(noted.alias("noted")), "noted", ["int", "float"])


@query(
    "V04_column_agreement",
    """WITH a AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT o_custkey, least(a.v, b.v) AS low, greatest(a.v, b.v) AS high, 0::BIGINT AS nulls, 2::BIGINT AS n FROM a JOIN b USING (o_custkey) WHERE a.v <> b.v""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    b = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    return checks.column_disagreements({"all": a, "finished": b}, ["o_custkey"], "v")


@query("V05_single_value", 'SELECT o_custkey, count(DISTINCT o_orderstatus) AS "values" FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1')
def _(spark, sf):
    return checks.groups_with_many_values(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("V06_referential", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, sf):
    return checks.missing_references(table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@query(
    "V07_complete_sequence",
    """SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1
       HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)""",
)
def _(spark, sf):
    return checks.incomplete_sequences(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")
