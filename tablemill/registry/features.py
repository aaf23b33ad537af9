"""Feature preparation."""

from pyspark.sql import functions as F

from tablemill.modeling import features as ops
from tablemill.registry.base import query, r6, table

STOP_WORDS = ["the", "of", "and", "that", "in", "it", "is", "on", "for", "with", "le", "la", "de", "un", "une", "et", "des", "der", "die", "und", "zu"]


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


@query(
    "X01_mean_impute",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size END AS size, p_retailprice AS price FROM part)
       SELECT p_partkey, R6(coalesce(size, (SELECT avg(size) FROM p))) AS size, (size IS NULL)::INT AS "size:ind", R6(price) AS price FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    return _r6(ops.mean_impute(p, ["size", "price"]), "size", "price")


@query(
    "X02_group_impute",
    """WITH e AS (SELECT event_id, ts::DATE AS day, CASE WHEN event_id % 5 > 0 THEN value END AS v FROM events)
       SELECT event_id, R6(coalesce(v, avg(v) OVER (PARTITION BY day))) AS v FROM e""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("v"))
    return _r6(ops.group_impute(e, ["day"], "v").select("event_id", "v"), "v")


@query(
    "X03_standardise",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 > 0)
       SELECT o_orderkey, R6((o_totalprice - m) / s) AS price FROM orders, s WHERE o_orderkey % 5 = 0""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    scaler = ops.fit_scaler(o.where("o_orderkey % 5 > 0"), ["price"])
    return _r6(ops.apply_scaler(o.where("o_orderkey % 5 = 0"), scaler), "price")


@query(
    "X04_one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "status.F", (o_orderstatus = 'O')::INT AS "status.O", (o_orderstatus = 'P')::INT AS "status.P" FROM orders""",
)
def _(spark, sf):
    return ops.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "status").drop("o_orderstatus")


@query(
    "X05_multi_value_one_hot",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_name END AS n FROM part)
       SELECT p_partkey, coalesce(list_contains(string_split(n, ' '), 'red'), FALSE)::INT AS "n:red", coalesce(list_contains(string_split(n, ' '), 'bolt'), FALSE)::INT AS "n:bolt",
              coalesce(list_contains(string_split(n, ' '), 'small'), FALSE)::INT AS "n:small" FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 > 0, F.replace("p_name", F.lit(" "), F.lit(","))).alias("n"))
    names = ops.multi_value_names(p, "n")
    return ops.multi_value_one_hot(p, "n", names).select("p_partkey", "`n:red`", "`n:bolt`", "`n:small`")


@query(
    "X06_polynomial",
    """SELECT p_partkey, R6(a * a) AS "a^2", R6(a * b) AS "a x b", R6(b * b) AS "b^2" FROM (SELECT p_partkey, p_size AS a, p_retailprice / 100 AS b FROM part)""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_retailprice") / 100).alias("b"), F.lit(0.0).alias("z"))
    got = ops.polynomial(p, ["a", "b", "z"])
    return _r6(got.drop("a", "b", "z"), "a^2", "a x b", "b^2")


@query(
    "X07_formula",
    """SELECT o_orderkey, R6(o_totalprice) AS label, R6(o_custkey) AS x0, R6((o_orderstatus = 'P')::INT) AS x1 FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("is_open", (F.col("o_orderstatus") == "P").cast("int"))
    text = ops.formula_text("o_totalprice", ["o_custkey", "o_orderdate"], add=["is_open"], subtract=["o_orderdate"])
    m = ops.design_matrix(o.select("o_orderkey", "o_totalprice", "o_custkey", "is_open"), text, ["o_orderkey"])
    return m.select("o_orderkey", r6("label").alias("label"), r6(F.col("x")[0]).alias("x0"), r6(F.col("x")[1]).alias("x1"))


@query(
    "X08_label_encode_unknown",
    """WITH v AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_size > 25 AND p_brand < 'Brand#2' UNION SELECT 'Unknown'), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
       SELECT p_partkey, coalesce(code, (SELECT code FROM c WHERE v = 'Unknown')) AS code FROM part LEFT JOIN c ON v = p_brand""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    codes = ops.label_codes(p.where("p_size > 25 AND p_brand < 'Brand#2'"), "p_brand")
    return ops.encode_labels(p, "p_brand", codes, "code").select("p_partkey", "code")


F_SQL = """f AS (SELECT 'quantity' AS feature, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'tax', corr(l_tax, l_extendedprice), count(*) FROM lineitem
       UNION ALL SELECT 'discount', corr(l_discount, l_extendedprice), count(*) FROM lineitem)"""


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"), "l_returnflag",
    )


@query("X09_k_best", f"WITH {F_SQL} SELECT feature, R6(r * r / (1 - r * r) * (n - 2)) AS f FROM f ORDER BY f DESC, feature LIMIT 2")
def _(spark, sf):
    return _r6(ops.k_best(_items(spark, sf), ["quantity", "tax", "discount"], "price", 2), "f")


@query(
    "X09_k_best_classes",
    """WITH c AS (SELECT 'quantity' AS feature, l_returnflag AS g, l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_returnflag, l_extendedprice FROM lineitem),
            m AS (SELECT feature, avg(v) AS m FROM c GROUP BY 1), g AS (SELECT feature, g, count(*) AS n, avg(v) AS gm, var_pop(v) AS s FROM c GROUP BY 1, 2)
       SELECT feature, R6((sum(n * (gm - m) * (gm - m)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*)))) AS f FROM g JOIN m USING (feature) GROUP BY 1""",
)
def _(spark, sf):
    return _r6(ops.k_best(_items(spark, sf), ["quantity", "price"], "l_returnflag", 5, "classification"), "f")


@query("X10_multi_output_select", f"WITH {F_SQL} SELECT feature FROM f ORDER BY r * r DESC, feature LIMIT 1")
def _(spark, sf):
    chosen = ops.select_for_outcomes(_items(spark, sf).withColumn("double_price", F.col("price") * 2), ["quantity", "tax", "discount"], ["price", "double_price"], 1, how="all")
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


@query(
    "X11_pca",
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT 1 AS component, R6((1 + r) / 2) AS share FROM r UNION ALL SELECT 2, R6((1 - r) / 2) FROM r""",
)
def _(spark, sf):
    return _r6(ops.explained_variance(_items(spark, sf), ["quantity", "price"], 2), "share")


@query(
    "X12_percentile_label",
    "SELECT o_orderkey, (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders))::INT AS label FROM orders",
)
def _(spark, sf):
    return ops.percentile_label(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.9).select("o_orderkey", "label")


WORDS_SQL = (
    r"w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}\p{N}]', '', 'g'), '\s+'), lambda x: length(x) > 0 AND x NOT IN ("
    + ", ".join(f"'{s}'" for s in STOP_WORDS)
    + ")) AS t FROM documents)"
)


@query(
    "X13_text_normalise_terms",
    f"""WITH {WORDS_SQL}, u AS (SELECT doc_id, unnest(t) AS term FROM w)
        SELECT md5(term) AS term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY u.term""",
)
def _(spark, sf):
    terms = ops.text_terms(table(spark, sf, "documents"), "doc_id", "text", STOP_WORDS)
    return ops.term_counts(terms, "doc_id").withColumn("term", F.md5(F.col("term").cast("binary")))


@query(
    "X13_bigrams",
    f"""WITH {WORDS_SQL}, z AS (SELECT doc_id, unnest(list_zip(t, t[2:], TRUE)) AS z FROM w), u AS (SELECT doc_id, z[1] || ' ' || z[2] AS term FROM z),
        c AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1)
        SELECT count(*) AS bigrams, sum(n)::BIGINT AS n, sum(documents)::BIGINT AS documents, max(n) AS top FROM c""",
)
def _(spark, sf):
    terms = ops.text_terms(table(spark, sf, "documents"), "doc_id", "text", STOP_WORDS)
    counts = ops.term_counts(ops.bigrams(terms, "doc_id"), "doc_id")
    return counts.agg(F.count("*").alias("bigrams"), F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.max("n").alias("top"))


@query(
    "X13_document_term_matrix",
    f"""WITH {WORDS_SQL}, u AS (SELECT doc_id, unnest(t) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS n FROM u GROUP BY 1, 2)
        SELECT doc_id, sum(n)::BIGINT AS n, count(*) AS terms FROM c WHERE term IN (SELECT term FROM c GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1""",
)
def _(spark, sf):
    terms = ops.text_terms(table(spark, sf, "documents"), "doc_id", "text", STOP_WORDS)
    m = ops.document_term_matrix(terms, "doc_id", 20)
    return m.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))


def _turns(spark, sf):
    terms = ops.text_terms(table(spark, sf, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn")), "key", "text", STOP_WORDS)
    return terms


@query("X14_topic_model")
def _(spark, sf):
    _, words, shares = ops.topic_models(_turns(spark, sf), "key", range(2, 11), top_words=5, min_documents=5, iterations=5)
    weight = shares.groupBy("topic").agg(F.sum("share").alias("documents"))
    return words.join(weight, "topic")


@query(
    "X14_topic_facts",
    f"""WITH {WORDS_SQL.replace("SELECT doc_id, ", "SELECT conv_id || ':' || turn AS key, ").replace("FROM documents", "FROM conversations")}, u AS (SELECT DISTINCT key, unnest(t) AS term FROM w),
        v AS (SELECT count(*) AS n FROM (SELECT term FROM u GROUP BY 1 HAVING count(*) >= 5))
        SELECT k::INT AS k, (SELECT n FROM v) AS vocabulary, (SELECT count(*) FROM w) AS documents FROM range(2, 11) AS r(k)""",
)
def _(spark, sf):
    quality, _, _ = ops.topic_models(_turns(spark, sf), "key", range(2, 11), top_words=5, min_documents=5, iterations=2)
    return quality.select("k", "vocabulary", "documents")
