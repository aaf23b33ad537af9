"""Scans, exports, sinks and page tables."""

from pyspark.sql import functions as F

from tablemill.operators.windows import union_all
from tablemill.registry.base import query, r6, table
from tablemill.session import fresh_folder
from tablemill.sources import pages, tables


@query(
    "S01_parquet_scan",
    """SELECT event_id, user_id, value FROM events
       WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND value < 100""",
)
def _(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp")
    wanted = (F.col("event_type") == "purchase") & (F.col("ts") >= day("2024-01-05")) & (F.col("ts") < day("2024-01-12"))
    return tables.scan(spark, f"{sf}/events.parquet", wanted & (F.col("value") < 100), ["event_id", "user_id", "value"])


@query("S02_latest_snapshot", "SELECT o_orderkey, 'taken=2001' AS taken FROM orders WHERE year(o_orderdate) = 2001")
def _(spark, sf):
    folder = fresh_folder(spark, "snapshots")
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("taken"))
    o.write.partitionBy("taken").parquet(folder)
    got = tables.latest_snapshot(spark, folder, "taken=")
    return got.select("o_orderkey", F.concat(F.lit("taken="), F.col("taken").cast("string")).alias("taken"))


def _export(spark, df, folder, name):
    """Write a table the way the database export does: marks, Latin-1, names beside it."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    record = F.encode(F.concat_ws(tables.FIELD_MARK, *fields), "ISO-8859-1").cast("string")
    df.select(record.alias("value")).write.option("lineSep", tables.RECORD_MARK).text(f"{folder}/{name}.csv")
    heads = spark.createDataFrame([(c,) for c in df.columns], "name string")
    heads.coalesce(1).write.csv(f"{folder}/{name}_Headers.csv")


@query(
    "S03_delimited_export",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'é ' || p_name AS p_name, CASE WHEN p_size % 5 > 0 THEN p_brand END AS p_brand FROM part",
)
def _(spark, sf):
    folder = fresh_folder(spark, "export")
    brand = F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).otherwise("  ")
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("é "), F.col("p_name")).alias("p_name"), brand.alias("p_brand"))
    _export(spark, p, folder, "Parts")
    names = tables.read_header(spark, f"{folder}/Parts_Headers.csv")
    return tables.delimited_export(spark, f"{folder}/Parts.csv", names)


CATALOG = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


def _catalog(spark, sf):
    """All tables as an export folder; signs that Latin-1 lacks become question marks."""
    folder = fresh_folder(spark, "catalog")
    for name in CATALOG:
        df = table(spark, sf, name)
        _export(spark, df.select(*[F.regexp_replace(F.col(c).cast("string"), r"[^\x00-\xFF]", "?").alias(c) for c in df.columns]), folder, name.title())
    return folder


@query(
    "S04_load_all_tables",
    " UNION ALL ".join(f"SELECT '{n.title()}' AS table_name, count(*) AS n, (SELECT count(*) FROM (DESCRIBE {n})) AS columns FROM {n}" for n in CATALOG if n != "region"),
)
def _(spark, sf):
    found = tables.load_all_tables(spark, _catalog(spark, sf), skip=["Region"], views=False)
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in found.items()]
    return union_all(*parts)


@query("S05_column_search", "SELECT * FROM (VALUES ('customer'), ('nation'), ('supplier')) t(table_name)")
def _(spark, sf):
    return tables.column_search(spark, tables.folder_tables(spark, sf), "NationKey")


@query(
    "S06_document_scan",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus = 'F'",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return tables.document_scan(o, "year", range(1996, 1998), {"o_orderstatus": "F"}, ["o_orderkey", "year"])


@query(
    "S07_map_field_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              CAST(json_extract_string(props, '$.k') AS INTEGER) // 7 AS week FROM events""",
)
def _(spark, sf):
    fields = tables.map_fields(table(spark, sf, "events"), "props", {"k": "int"})
    return fields.select("event_id", "k", F.floor(F.col("k") / 7).cast("int").alias("week"))


@query(
    "S08_keyed_upsert",
    """WITH batch AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal FROM orders GROUP BY 1)
       SELECT c.c_custkey, c.c_acctbal FROM customer c WHERE c.c_custkey NOT IN (SELECT c_custkey FROM batch)
       UNION ALL SELECT c_custkey, c_acctbal FROM batch""",
)
def _(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return tables.keyed_upsert(old, batch, ["c_custkey"], ["o_orderkey"])


@query("S09_bucketed_sink", "SELECT CAST(o_orderkey % 10 AS INTEGER) AS bucket, count(*) AS n, 1::BIGINT AS files FROM orders GROUP BY 1")
def _(spark, sf):
    path = fresh_folder(spark, "buckets")
    tables.bucketed_write(table(spark, sf, "orders").select("o_orderkey"), path, "o_orderkey", 10)
    stored = spark.read.parquet(path)
    return stored.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("_metadata.file_path").alias("files"))


@query("S10_file_sink", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    path = fresh_folder(spark, "csv")
    tables.file_write(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").option("header", True).csv(path)


@query("S11_materialize", "SELECT o_orderpriority, count(*) AS n, R6(sum(o_totalprice)) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    folder = fresh_folder(spark, "stored")

    def build():
        o = table(spark, sf, "orders").groupBy("o_orderpriority")
        return o.agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("total"))

    tables.materialize(spark, "by_priority", build, folder)
    return tables.materialize(spark, "by_priority", build, folder)


@query(
    "S12_n_line_records",
    "SELECT c_custkey, c_name, c_nationkey FROM customer",
)
def _(spark, sf):
    path = fresh_folder(spark, "lines")
    c = table(spark, sf, "customer").select(
        F.concat_ws("\n", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")).alias("value")
    )
    c.write.text(path)
    records = tables.n_line_records(spark, path, {"c_custkey": "long", "c_name": "string", "c_nationkey": "int"})
    return records.select("c_custkey", "c_name", "c_nationkey")


def _pages_with_table(spark, sf):
    """The raw pages, each with a readings table derived from its own length and address."""
    n = F.length("html").cast("string")
    actual = F.when(F.col("page_id") % 5 == 0, "MM").when(F.col("page_id") % 5 == 1, "T trace").when(F.col("page_id") % 5 == 2, "-").otherwise(
        F.concat(n, F.lit(" mm"))
    )
    rows = F.concat(
        F.lit("<table><tr><th>Reading</th><th>Actual</th><th>Average (10y)</th></tr><tr><td><a href='"), F.col("url"), F.lit("'>Rain</a>"),
        F.lit("<td>"), actual, F.lit("</td><td> "), F.col("page_id").cast("string"), F.lit(".5 mm</td></tr></table></body>"),
    )
    return table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("</body>"), rows).alias("html"))


ACTUAL = "CASE page_id % 5 WHEN 0 THEN 'MM' WHEN 1 THEN 'T trace' WHEN 2 THEN '-' ELSE length(html) || ' mm' END"


@query(
    "S13_html_tables",
    f"""WITH p AS (SELECT * FROM pages WHERE contains(html, '</body>'))
        SELECT page_id, 0 AS table_no, 0 AS row_no, c AS col_no, 1 AS is_header, ['Reading', 'Actual', 'Average (10y)'][c + 1] AS text, '' AS href
        FROM p, (VALUES (0), (1), (2)) v(c)
        UNION ALL SELECT page_id, 0, 1, 0, 0, 'Rain', url FROM p
        UNION ALL SELECT page_id, 0, 1, 1, 0, {ACTUAL}, '' FROM p
        UNION ALL SELECT page_id, 0, 1, 2, 0, page_id || '.5 mm', '' FROM p""",
)
def _(spark, sf):
    cells = pages.html_tables(_pages_with_table(spark, sf))
    return cells.withColumns({"is_header": F.col("is_header").cast("int"), "href": F.coalesce("href", F.lit(""))})


@query(
    "S14_html_metric_lookup",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN page_id + 0.5::DOUBLE ELSE length(html)::DOUBLE END AS value
       FROM pages WHERE contains(html, '</body>')""",
)
def _(spark, sf):
    return pages.table_lookup(pages.html_tables(_pages_with_table(spark, sf)), "Rain").select("page_id", "value")
