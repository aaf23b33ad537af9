"""Scalar expressions and column transforms."""

from pyspark.sql import functions as F

from tablemill.functions import numbers, text, times
from tablemill.operators import columns as ops
from tablemill.registry.base import day_text, query, r6, table, time_text


def _part_text(spark, sf):
    size = F.col("p_size") % 5
    noted = F.when(size == 0, "n/a").when(size == 1, "").otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf, "part").select("p_partkey", noted.alias("noted"))


PART_TEXT = "(SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE CAST(p_retailprice AS VARCHAR) END AS noted FROM part)"


@query("P01_coerce_numeric", f"SELECT p_partkey, TRY_CAST(noted AS DOUBLE) AS amount FROM {PART_TEXT}")
def _(spark, sf):
    return _part_text(spark, sf).select("p_partkey", numbers.coerce_numeric(F.col("noted")).alias("amount"))


@query(
    "P02_coerce_id",
    """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust FROM orders WHERE o_orderkey % 7 <> 0""",
)
def _(spark, sf):
    noted = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string"))
    return ops.coerce_id(table(spark, sf, "orders").select("o_orderkey", noted.alias("cust")), "cust")


@query(
    "P03_fill_category",
    """SELECT COALESCE(CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END, 'Unknown') AS segment,
              count(*) AS n FROM customer GROUP BY 1""",
)
def _(spark, sf):
    segment = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment"))
    c = table(spark, sf, "customer").select(text.fill_category(segment).alias("segment"))
    return c.groupBy("segment").agg(F.count("*").alias("n"))


@query(
    "P04_first_non_null",
    """SELECT l_returnflag, l_linestatus, R6(sum(COALESCE(NULLIF(l_discount, 0), NULLIF(l_tax, 0), l_quantity))) AS total
       FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    value = F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), "l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.sum(value)).alias("total"))


@query("P05_one_value", "SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf):
    return ops.one_value(table(spark, sf, "customer"), ["c_custkey"], "c_mktsegment")


@query(
    "P06_month_trunc",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n FROM orders GROUP BY 1",
)
def _(spark, sf):
    month = times.month_start(time_text("o_orderdate"))
    return table(spark, sf, "orders").groupBy(day_text(month).alias("month")).agg(F.count("*").alias("n"))


@query(
    "P07_fixed_round_down",
    """SELECT event_id,
              strftime(make_timestamp(CAST(epoch_us(ts) // 900000000 * 900000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS quarter_hour,
              strftime(make_timestamp(CAST(epoch_us(ts) // 7200000000 * 7200000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS two_hours,
              strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS one_day
       FROM events""",
)
def _(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        time_text(times.floor_time(ts, 900)).alias("quarter_hour"),
        time_text(times.floor_time(ts, 7200)).alias("two_hours"),
        time_text(times.floor_time(ts, times.DAY)).alias("one_day"),
    )


@query(
    "P08_anchored_round",
    """SELECT strftime(d, '%Y-%m-%d') AS day,
              strftime(date_trunc('week', d), '%Y-%m-%d') AS monday,
              strftime(d - CAST((isodow(d) + 4) % 7 AS INTEGER), '%Y-%m-%d') AS wednesday,
              strftime(date_trunc('quarter', d), '%Y-%m-%d') AS quarter,
              strftime(d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER), '%Y-%m-%d') AS business
       FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def _(spark, sf):
    d = F.col("d")
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(
        day_text(d).alias("day"),
        day_text(times.week_floor(d)).alias("monday"),
        day_text(times.week_floor(d, 2)).alias("wednesday"),
        day_text(times.quarter_floor(d)).alias("quarter"),
        day_text(times.business_floor(d)).alias("business"),
    )


@query(
    "P09_nearest_round",
    """SELECT strftime(make_timestamp(CAST(round_even(epoch_us(ts) / 3.6e9, 0) AS BIGINT) * 3600000000), '%Y-%m-%d %H:%M:%S') AS hour,
              count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    hour = time_text(times.round_time(F.col("ts"), 3600))
    return table(spark, sf, "events").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


@query(
    "P10_week_calendar",
    """WITH days AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS d FROM orders),
            weeks AS (SELECT year, d, d - CAST((isodow(d) + 4) % 7 AS INTEGER) AS week FROM days),
            numbered AS (SELECT year, d, week, 1 + (week - min(week) OVER (PARTITION BY year)) // 7 AS no FROM weeks)
       SELECT year, strftime(d, '%Y-%m-%d') AS day, strftime(week, '%Y-%m-%d') AS week,
              CAST(CASE WHEN year = 2001 AND no > 1 THEN no - 1 ELSE no END AS BIGINT) AS week_number FROM numbered""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"))
    got = ops.week_calendar(o, "year", "day", weekday=2, skipped={2001: 1})
    return got.select("year", day_text("day").alias("day"), day_text("week").alias("week"), "week_number")


@query(
    "P11_epoch_window",
    """SELECT w AS week, w * 604800 - 259200 AS start_second, w * 604800 + 345599 AS stop_second, count(*) AS n
       FROM (SELECT CAST(epoch_us(ts) // 1000000 // 604800 AS BIGINT) AS w FROM events) GROUP BY w""",
)
def _(spark, sf):
    week = times.epoch_week(F.unix_seconds("ts"))
    counts = table(spark, sf, "events").groupBy(week.alias("week")).agg(F.count("*").alias("n"))
    start, stop = times.epoch_week_start(F.col("week")), times.epoch_week_stop(F.col("week"))
    return counts.select("week", start.alias("start_second"), stop.alias("stop_second"), "n")


@query(
    "P12_first_number",
    r"SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE) AS number FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", numbers.first_number(F.col("text")).alias("number"))


@query(
    "P13_stat_to_number",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(floor(value) AS DOUBLE) WHEN 1 THEN CAST(user_id AS DOUBLE)
              WHEN 2 THEN 0.0 WHEN 3 THEN CAST(floor(value) AS DOUBLE) ELSE 3.0 END AS number FROM events""",
)
def _(spark, sf):
    kind, whole = F.col("event_id") % 5, F.floor("value").cast("string")
    noted = (
        F.when(kind == 0, F.concat(whole, F.lit("t")))
        .when(kind == 1, F.concat(F.col("user_id").cast("string"), F.lit("/400")))
        .when(kind == 2, "--")
        .when(kind == 3, whole)
        .otherwise(F.concat_ws(",", whole, whole, whole))
    )
    metric = F.when(kind == 4, "kicking:Miss").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", numbers.stat_number(metric, noted).alias("number"))


@query(
    "P14_side_split",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size % 9 END AS left_mm,
              CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size % 7 END AS right_mm FROM part""",
)
def _(spark, sf):
    size = F.col("p_size")
    note = F.format_string("Left - %dmm, Right - %dmm", size % 9, size % 7)
    own = F.col("p_partkey") % 3 == 0

    def side(name, column):
        return F.coalesce(F.when(own, column), text.side_value(note, name, r"(\d+)mm").cast("int"))

    return table(spark, sf, "part").select("p_partkey", side("left", size).alias("left_mm"), side("right", size + 1).alias("right_mm"))


@query(
    "P15_canonical_label",
    """WITH noted AS (SELECT p_partkey, lower(['Brisk L', 'brsik', 'BIRSK?', 'fixed', 'nonReactive', 'sluggish', 'uta'][p_partkey % 7 + 1]) AS t FROM part),
            found AS (SELECT p_partkey, NULLIF(regexp_extract(t, '(brisk|brsik|birsk|fixed|nonreactive|sluggish|uta)', 1), '') AS w FROM noted),
            word AS (SELECT p_partkey, CASE WHEN array_to_string(list_sort(string_split(w, '')), '') = 'bikrs' THEN 'brisk' ELSE w END AS word FROM found)
       SELECT p_partkey, word, CASE word WHEN 'nonreactive' THEN 1 WHEN 'fixed' THEN 2 WHEN 'sluggish' THEN 3 WHEN 'brisk' THEN 4 END AS level FROM word""",
)
def _(spark, sf):
    samples = F.array(*[F.lit(w) for w in ("Brisk L", "brsik", "BIRSK?", "fixed", "nonReactive", "sluggish", "uta")])
    noted = F.get(samples, (F.col("p_partkey") % 7).cast("int"))
    words = table(spark, sf, "part").select("p_partkey", text.canonical_reaction(noted).alias("word"))
    return words.withColumn("level", text.reaction_level(F.col("word")))


@query(
    "P16_name_normalise",
    "SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS cust_segment FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Account Id"), F.col("c_name").alias("Account, Name "), F.col("c_mktsegment").alias("MKT Segment")
    )
    named = text.tidy_names(c, aliases={"mkt_segment": "segment"})
    return text.affix_names(named, prefix="cust_", keep=["account_id", "account_name"])


@query(
    "P17_text_clean",
    r"""SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')) AS ascii_md5,
               md5(regexp_replace(text, '[^A-Za-z0-9_\-]', '', 'g')) AS word_md5,
               upper(substr(source, 1, 1)) || substr(source, 2) AS source_title FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.ascii_only(t).cast("binary")).alias("ascii_md5"),
        F.md5(text.word_characters(t).cast("binary")).alias("word_md5"),
        text.title_text(F.col("source")).alias("source_title"),
    )


@query(
    "P18_split_tail",
    r"""SELECT page_id, string_split(url, '/')[4] AS part4, string_split(url, '/')[-1] AS tail,
               array_to_string(string_split(url, '/')[:-2], '/') AS head,
               string_split(url, '://')[1] AS scheme,
               'Hall ' || page_id AS stadium, string_split(url, '://')[1] || ', ST' AS place
        FROM pages""",
)
def _(spark, sf):
    url = F.col("url")
    scheme = text.token(url, "://", 1)
    noted = F.concat(F.lit("Hall "), F.col("page_id").cast("string"), F.lit(" ("), scheme, F.lit(", ST)"))
    stadium, place = text.place_in_brackets(noted)
    return table(spark, sf, "pages").select(
        "page_id",
        text.token(url, "/", 4).alias("part4"),
        text.last_token(url, "/").alias("tail"),
        text.all_but_last_token(url, "/").alias("head"),
        scheme.alias("scheme"),
        stadium.alias("stadium"),
        place.alias("place"),
    )


@query(
    "P19_clock_minutes",
    """SELECT CAST(CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END * 60 + minute(ts) AS INTEGER) AS minutes,
              count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    clock = F.date_format("ts", "hh:mma")
    return table(spark, sf, "events").groupBy(times.clock_minutes(clock).alias("minutes")).agg(F.count("*").alias("n"))


@query(
    "P20_label_format",
    """SELECT c_custkey, c_custkey || ':' || c_nationkey || ' (' || c_name || ' | ' || c_mktsegment || ')' AS label FROM customer""",
)
def _(spark, sf):
    c = F.col
    label = text.point_label(c("c_custkey"), c("c_nationkey"), c("c_name"), c("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", label.alias("label"))


@query(
    "P21_unit_convert",
    """SELECT p_partkey, R6(CASE p_partkey % 4 WHEN 0 THEN p_size * 3.78541::DOUBLE WHEN 1 THEN p_size WHEN 2 THEN p_size * 1000 END) AS litres FROM part""",
)
def _(spark, sf):
    units = F.array(F.lit("Gallons"), F.lit(" liters "), F.lit("Cubic Meters"), F.lit("unknown"))
    unit = F.get(units, (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", r6(numbers.to_litres(F.col("p_size"), unit)).alias("litres"))


@query(
    "P22_parameter_units",
    """WITH noted AS (
         SELECT CASE l_returnflag WHEN 'R' THEN 'Lead' WHEN 'A' THEN 'Temperature' ELSE 'Total Coliforms' END AS parameter,
                CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber < 4 THEN 'mg/L' ELSE 'ppb' END
                     WHEN 'A' THEN CASE WHEN l_linenumber < 4 THEN 'Celsius' ELSE 'Fahrenheit' END ELSE 'CFU/100ml' END AS unit,
                l_returnflag AS flag, l_linenumber AS no, l_quantity AS q FROM lineitem),
       done AS (
         SELECT parameter, unit AS original_unit,
                CASE flag WHEN 'R' THEN 'mg/L' WHEN 'A' THEN 'Celsius' ELSE unit END AS unit,
                CASE WHEN flag = 'R' AND no >= 4 THEN q / 1000.0 WHEN flag = 'R' THEN q
                     WHEN flag = 'A' AND no >= 4 THEN (q - 32.0) * (5 / 9.0::DOUBLE) WHEN flag = 'A' THEN q
                     WHEN no = 1 THEN 5000 WHEN no = 2 THEN NULL WHEN no = 3 THEN least(q * 1000, 5000) ELSE q END AS value
         FROM noted)
       SELECT parameter, original_unit, unit, count(*) AS n, R6(sum(value)) AS total, R6(max(value)) AS top
       FROM done WHERE parameter <> 'Total Coliforms' OR value IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    flag, no, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    parameter = F.when(flag == "R", "Lead").when(flag == "A", "Temperature").otherwise("Total Coliforms")
    unit = (
        F.when(flag == "R", F.when(no < 4, "mg/L").otherwise("ppb"))
        .when(flag == "A", F.when(no < 4, "Celsius").otherwise("Fahrenheit"))
        .otherwise("CFU/100ml")
    )
    count = F.when(no == 1, "TNTC").when(no == 2, "see note").when(no == 3, (q * 1000).cast("string")).otherwise(q.cast("string"))
    value = F.when(flag.isin("R", "A"), q.cast("string")).otherwise(count)
    noted = table(spark, sf, "lineitem").select(parameter.alias("parameter"), unit.alias("unit"), value.alias("value"))
    done = ops.convert_parameter_units(noted)
    return done.groupBy("parameter", "original_unit", "unit").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("total"), r6(F.max("value")).alias("top")
    )


@query(
    "P23_geo_sign_fix",
    """WITH places AS (SELECT c_custkey, coalesce(['Peru', 'Haiti', 'Indonesia', 'Mexico', 'Liberia', 'Malawi', 'Kenya'][c_nationkey + 1], 'Other') AS country,
                 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 - 30 END AS lat, c_acctbal / 50 - 60 AS lon FROM customer),
            fixed AS (SELECT *, CASE WHEN country IN ('Peru', 'Malawi') THEN -abs(lat) WHEN country IN ('Haiti', 'Liberia') THEN abs(lat) ELSE lat END AS clat,
                 CASE WHEN country IN ('Peru', 'Haiti', 'Mexico') THEN -abs(lon) WHEN country IN ('Indonesia', 'Malawi', 'Kenya') THEN abs(lon) ELSE lon END AS clon
                 FROM places WHERE lat IS NOT NULL)
       SELECT c_custkey, country, R6(clat) AS corrected_lat, R6(clon) AS corrected_lon,
              CAST(lat <> clat OR lon <> clon AS INTEGER) AS is_error FROM fixed""",
)
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in ("Peru", "Haiti", "Indonesia", "Mexico", "Liberia", "Malawi", "Kenya")])
    places = table(spark, sf, "customer").select(
        "c_custkey",
        F.coalesce(F.get(names, "c_nationkey"), F.lit("Other")).alias("country"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 100 - 30).alias("lat"),
        (F.col("c_acctbal") / 50 - 60).alias("lon"),
    )
    fixed = ops.fix_coordinate_signs(places, "country", "lat", "lon")
    return fixed.select(
        "c_custkey", "country", r6("corrected_lat").alias("corrected_lat"), r6("corrected_lon").alias("corrected_lon"),
        F.col("is_error").cast("int").alias("is_error"),
    )


@query(
    "P24_outcome_bins",
    """WITH g AS (SELECT p_partkey, NULLIF(p_size % 6, 0) AS a, NULLIF(p_partkey % 6, 0) AS b FROM part)
       SELECT p_partkey, CASE WHEN a IN (2, 3) THEN 0 WHEN a IN (4, 5) THEN 1 END AS "gos-3-favalive",
              CASE WHEN a IN (1, 2, 3) THEN 0 WHEN a IN (4, 5) THEN 1 END AS "gos-3-favorable", CAST(a > 1 AS INTEGER) AS "gos-3-alive",
              CASE WHEN b IN (2, 3) THEN 0 WHEN b IN (4, 5) THEN 1 END AS "gos-12-favalive",
              CASE WHEN b IN (1, 2, 3) THEN 0 WHEN b IN (4, 5) THEN 1 END AS "gos-12-favorable", CAST(b > 1 AS INTEGER) AS "gos-12-alive"
       FROM g""",
)
def _(spark, sf):
    g = table(spark, sf, "part").select(
        "p_partkey",
        F.nullif(F.col("p_size") % 6, F.lit(0)).alias("gos-3"),
        F.nullif((F.col("p_partkey") % 6).cast("int"), F.lit(0)).alias("gos-12"),
    )
    return ops.outcome_bins(g, "gos").drop("gos-3", "gos-12")


@query(
    "P25_asinh_log",
    """SELECT p_partkey, R6(asinh(p_retailprice)) AS price_Log, CAST(p_size % 10 = 0 AS INTEGER) AS is_negative_infinity,
              CASE WHEN p_size % 10 > 0 THEN R6(log10(p_size % 10)) END AS size_Log FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") % 10).cast("double").alias("size"))
    logged = ops.log_columns(ops.log_columns(p, ["price"], "asinh"), ["size"], "log10")
    minus = F.col("size_Log") == float("-inf")
    return logged.select(
        "p_partkey", r6("price_Log").alias("price_Log"), minus.cast("int").alias("is_negative_infinity"),
        F.when(~minus, r6("size_Log")).alias("size_Log"),
    )


@query(
    "P26_floor_neg_inf",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN log10(o_totalprice) END AS x FROM orders),
            b AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
       SELECT o_orderkey, R6(coalesce(x, lo - 0.1 * (hi - lo))) AS x FROM v, b""",
)
def _(spark, sf):
    price = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice"))
    v = table(spark, sf, "orders").select("o_orderkey", numbers.log10_value(price).alias("x"))
    return ops.floor_negative_infinity(v, ["x"]).select("o_orderkey", r6("x").alias("x"))


@query(
    "P27_prefix_sums",
    """WITH m AS (SELECT l_linenumber AS no, l_extendedprice AS i1, CASE WHEN l_linenumber > 1 THEN l_tax * 100 ELSE 0 END AS i2,
                         l_discount * 1000 AS e1, l_quantity AS c1, l_quantity * 2 AS c2, l_quantity * 3 AS c3, l_tax AS c4, l_quantity AS w FROM lineitem)
       SELECT no, R6(sum(i1 + i2)) AS income_all, R6(sum(e1)) AS expenses_all, R6(sum(i1 + i2 - e1)) AS income_net,
              R6(sum(c1 + c2)) AS cash_beginning, R6(sum(c3 + c4)) AS cash_end, R6(sum(c3 + c4 - c1 - c2)) AS cash_net, R6(sum(w)) AS water FROM m GROUP BY no""",
)
def _(spark, sf):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    m = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("no"),
        F.col("l_extendedprice").alias("IncomeSales"),
        F.when(F.col("l_linenumber") > 1, tax * 100).alias("IncomeOther"),
        (F.col("l_discount") * 1000).alias("ExpensesParts"),
        q.alias("CashInBankBeginning"), (q * 2).alias("CashOnHandBeginning"), (q * 3).alias("CashInBankEnd"), tax.alias("CashOnHandEnd"),
        q.alias("QuantityWaterSold"),
    )
    s = ops.add_calculated_sums(m)
    names = {
        "IncomeAll": "income_all", "ExpensesAll": "expenses_all", "IncomeNet": "income_net", "CashBeginning": "cash_beginning",
        "CashEnd": "cash_end", "CashNet": "cash_net", "QuantityWaterAll": "water",
    }
    return s.groupBy("no").agg(*[r6(F.sum(k)).alias(v) for k, v in names.items()])


@query(
    "P28_currency_convert",
    """SELECT o_orderpriority, R6(sum(o_totalprice / CASE WHEN o_orderpriority <> '5-LOW' THEN 1 + o_custkey % 3 END)) AS total FROM orders GROUP BY 1""",
)
def _(spark, sf):
    rate = F.when(F.col("o_orderpriority") != "5-LOW", 1.0 + F.col("o_custkey") % 3)
    o = ops.divide_family(table(spark, sf, "orders").withColumn("rate", rate), ["o_totalprice"], "rate")
    return o.groupBy("o_orderpriority").agg(r6(F.sum("o_totalprice")).alias("total"))


@query(
    "P29_binary_derived",
    """WITH r AS (SELECT p_partkey, p_retailprice - p_size AS d, CASE WHEN p_size > 10 THEN ln(p_retailprice / (p_size - 10)) END AS q FROM part)
       SELECT p_partkey, R6(d) AS price_minus_size, R6(coalesce(q, (SELECT min(q) FROM r))) AS price_size_ratio FROM r""",
)
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("reduced", F.col("p_size") - 10)
    fields = [
        {"op": "diff", "left": "p_retailprice", "right": "p_size", "result": "price_minus_size"},
        {"op": "log_ratio", "left": "p_retailprice", "right": "reduced", "result": "price_size_ratio"},
    ]
    got = ops.add_binary_fields(p, fields)
    return got.select("p_partkey", r6("price_minus_size").alias("price_minus_size"), r6("price_size_ratio").alias("price_size_ratio"))


@query(
    "P30_safe_fraction",
    """SELECT o_custkey, R6(coalesce(count(*) FILTER (o_orderstatus = 'F') / NULLIF(count(*) FILTER (o_orderstatus = 'O'), 0), 0)) AS fraction
       FROM orders GROUP BY 1""",
)
def _(spark, sf):
    finished, open_ = (F.count(F.when(F.col("o_orderstatus") == s, 1)) for s in ("F", "O"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(r6(numbers.safe_fraction(finished, open_)).alias("fraction"))


@query(
    "P31_conditional_transform",
    "SELECT o_orderkey, R6(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 2 ELSE o_totalprice END) AS price FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    done, _ = ops.conditional_transform(o, "o_totalprice", F.col("o_orderstatus") == "P", F.col("o_totalprice") / 2, target="price")
    return done.select("o_orderkey", r6("price").alias("price"))


@query("P32_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[numbers.digest(F.col("text"), k).alias(k) for k in ("md5", "sha1", "sha256")])


@query(
    "P33_sigmoid",
    """SELECT c_custkey, R6(1 / (1 + exp(-((c_acctbal - 4500) / 1000)))) AS plain,
              R6(1 / (1 + exp(-least(greatest((c_acctbal - 4500) / 1000, -2), 2)))) AS clipped FROM customer""",
)
def _(spark, sf):
    x = (F.col("c_acctbal") - 4500) / 1000
    return table(spark, sf, "customer").select("c_custkey", r6(numbers.sigmoid(x)).alias("plain"), r6(numbers.sigmoid(x, 2.0)).alias("clipped"))


@query("P34_select_by_regex", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return text.select_matching(o, pattern=r"^o_order", names=["o_custkey"], expected=4)


@query(
    "P35_split_mirror",
    "SELECT l_partkey AS l_suppkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return text.swap_columns(pairs, "l_partkey", "l_suppkey").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))


@query(
    "P36_time_frame",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'Past' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'Future' ELSE 'Current' END AS frame,
              count(*) AS n FROM orders GROUP BY 1""",
)
def _(spark, sf):
    frame = times.time_frame(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf, "orders").groupBy(frame.alias("frame")).agg(F.count("*").alias("n"))


@query(
    "P37_minmax_priority",
    """WITH b AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part),
            s AS (SELECT p_partkey, R6(0.25 * (p_size - s0) / (s1 - s0) + 0.75 * (p_retailprice - r0) / (r1 - r0)) AS priority FROM part, b)
       SELECT p_partkey, priority FROM s ORDER BY priority DESC, p_partkey LIMIT 10""",
)
def _(spark, sf):
    scored = ops.weighted_priority(table(spark, sf, "part"), {"p_size": 50, "p_retailprice": 150})
    return ops.top_by(scored.select("p_partkey", r6("priority").alias("priority")), ["-priority", "p_partkey"], 10)


@query(
    "P38_mean_scaler",
    "SELECT o_orderkey, R6(o_totalprice / (SELECT avg(o_totalprice) FROM orders)) AS scaled, R6(o_totalprice) AS restored FROM orders",
)
def _(spark, sf):
    scaled = ops.mean_scale(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    scaled = scaled.withColumn("scaled", F.col("o_totalprice"))
    restored = ops.mean_unscale(scaled, ["o_totalprice"])
    return restored.select("o_orderkey", r6("scaled").alias("scaled"), r6("o_totalprice").alias("restored"))
