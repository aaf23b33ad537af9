"""The registered queries of the operators: each applies one to its whole table and gives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import decontam, extraction, langid, lattice, mixing, ngram, periodic, pii, sharding, tokenfiles, toxicity, vectorcodes, warc
from tablemill.llm.common import crc_fold, spread_join, word_count
from tablemill.session import fresh_folder

#: A document is called toxic from this score on.
TOXIC = 0.7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return lattice.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach AS r JOIN l ON l.a = r.b
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = fresh_folder(spark, "warc")
    records = warc.records(table(spark, folder, "pages"))
    warc.write(records, archive)
    rows = warc.read(spark, archive, payload=False)
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), r AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM r WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = r.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> r.page_id THEN f.first END AS refers_to
FROM r LEFT JOIN f ON r.payload_bytes >= 100 AND f.payload_digest = r.payload_digest
"""


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(crc_fold("doc_id", 5) != 0))
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.language(spark, "text", model).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.size("r.spans").alias("n_spans"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = ngram.linked_components(docs, words=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + least(4, len(w)) - 1) AS g
  FROM w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(k) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN l ON l.a = r.b
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) AS c LEFT JOIN n USING (doc_id)
"""


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = sharding.shuffle_shards(docs, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("overlap.ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    items = F.col("overlap.items")
    return found.select(
        "doc_id", F.col("overlap.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT item_id, list_slice(w, k, k + least(10, len(w)) - 1) AS win, least(10, len(w)) AS n
  FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(k) WHERE len(w) > 0
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), t AS (
  SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win
  FROM d, (SELECT DISTINCT n FROM v) AS s, unnest(generate_series(1, len(w) - n + 1)) AS g(k)
), m AS (
  SELECT t.doc_id, t.k, t.n, v.item_id FROM t JOIN v ON t.n = v.n AND t.win = v.win
), h AS (
  SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM m, unnest(generate_series(0, n - 1)) AS g(o) GROUP BY 1
), u AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(u.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(u.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN u USING (doc_id)
"""


def op8_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    trees = extraction.train(pages)
    found = pages.select("page_id", "url", extraction.main_text(spark, "html", trees).alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter((crc_fold("doc_id", 3) != 1) & F.col("toxic").isNotNull())
    # rows of one document that disagree count as toxic from one half on
    labels = labels.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    index = toxicity.learn(docs, labels)
    held_out = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(spark, "text", index).alias("r"))
    score = F.col("r.score")
    return found.select("doc_id", "held_out", score.alias("score"), (score >= TOXIC).cast("int").alias("predicted"), F.concat_ws(",", "r.evidence.example").alias("evidence"))


def digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", pii.pii_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(pii.KINDS[:4]))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *[count(k) for k in pii.KINDS[:4]], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))

def op11_vectorcodes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    codes, books = vectorcodes.compress(vectors, "vec_id", "embedding", carry=["label"])
    # nulls make one group, so the label is joined as a pair
    codes = codes.withColumn("group", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")))
    totals = codes.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    found = spread_join(codes, totals, "group", "n", ["vec_id"])
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The two rounds and the last assignment spelt out."""
    parts = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, k AS part, list_slice(v, 4 * k + 1, 4 * k + 4) AS x FROM v, range(16) AS t(k)
), b0 AS (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY 1 LIMIT 64)
)"""
    gap = " + ".join(f"(x[{i}] - e[{i}]) * (x[{i}] - e[{i}])" for i in range(1, 5))
    for turn in range(3):
        parts += f""", d{turn} AS (
  SELECT vec_id, part, entry, x, {gap} AS gap FROM p JOIN b{turn} USING (part)
), a{turn} AS (
  SELECT vec_id, part, min(gap) AS gap, arg_min(entry, gap * 64 + entry) AS entry, any_value(x) AS x FROM d{turn} GROUP BY 1, 2
)"""
        if turn < 2:
            means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
            parts += f""", m{turn} AS (
  SELECT part, entry, [{means}] AS e FROM a{turn} GROUP BY 1, 2
), b{turn + 1} AS (
  SELECT part, entry, coalesce(m{turn}.e, b{turn}.e) AS e FROM b{turn} LEFT JOIN m{turn} USING (part, entry)
)"""
    return parts + """, h AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
), c AS (
  SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a2 GROUP BY 1
), l AS (
  SELECT v.label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (vec_id) GROUP BY 1
)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM c JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h
"""


OP11_SQL = _codes_sql()

def op12_periodic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = word_count("text"), F.floor(h / 10)
    a = g % n
    # every tenth document becomes periodic from some word on
    loop = F.when((h % 10 == 0) & (n > 0), F.struct(a.alias("start"), (1 + F.floor((n - a) / (3 + g % 8))).alias("period")))
    found = periodic.collapse(docs.withColumn("loop", loop), "text", "loop")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("top"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("top.l") / F.col("top.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH t AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) AS h
  FROM documents, t
), s AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), l AS (
  SELECT doc_id, w, n, a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM s
), x AS (
  SELECT doc_id, i, w[1 + CASE WHEN p IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM l, unnest(range(n)) AS u(i)
), g AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS gram FROM x
), m AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q, l.i - row_number() OVER (PARTITION BY l.doc_id, r.i - l.i ORDER BY l.i) AS island
  FROM g AS l JOIN g AS r ON l.doc_id = r.doc_id AND l.gram = r.gram AND l.i < r.i WHERE len(l.gram) = 6
), c AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM m GROUP BY doc_id, q, island
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM c WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3
), f AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(r, [-length, start, period]) AS top, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM r GROUP BY 1
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  ANTI JOIN (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r) AS gone USING (doc_id, i) GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length,
  CAST(top.period AS BIGINT) AS period, CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op13_tokenfiles(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    archive = fresh_folder(spark, "tokens")
    tokenfiles.write(docs, archive, public_tokenizers.path("byte_bpe_50k.json"))
    places = tokenfiles.lookup(archive, tokenfiles.keys_of(docs), turn="turn")
    found = tokenfiles.checksums(archive, places)
    return found.select("doc_id", "start", F.col("n").cast("long").alias("n_tokens"), "ids_crc32")


QUERIES = {
    "op1_mix": op1_mix, "op2_neardup": op2_neardup, "op5_ngram_join": op5_ngram_join, "op3_warc": op3_warc, "op4_language": op4_language, "op6_shards": op6_shards, "op7_decontaminate": op7_decontaminate,
    "op8_extract": op8_extract, "op9_toxicity": op9_toxicity, "op10_pii": op10_pii,
    "op11_vectorcodes": op11_vectorcodes, "op12_periodic": op12_periodic, "op13_tokenfiles": op13_tokenfiles,
}
SQL = {"op2_neardup": OP2_SQL, "op5_ngram_join": OP5_SQL, "op3_warc": OP3_SQL, "op7_decontaminate": OP7_SQL, "op11_vectorcodes": OP11_SQL, "op12_periodic": OP12_SQL}
