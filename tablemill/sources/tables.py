"""Scans, exports, snapshots, upserts and sinks."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import blank_to_null
from tablemill.skew import top_rows

FIELD_MARK = "|###|"
RECORD_MARK = "|:::|"


def scan(spark: SparkSession, path: str, predicate: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Columnar scan; filter and projection reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df if predicate is None else df.where(predicate)
    return df.select(*columns) if columns else df


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is folder, bytes) of the entries of a folder on any Hadoop file system; a folder has the bytes of the files inside."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    size = lambda s: fs.getContentSummary(s.getPath()).getLength() if s.isDirectory() else s.getLen()
    return sorted((s.getPath().getName(), s.isDirectory(), size(s)) for s in fs.listStatus(target))


def folder_tables(spark: SparkSession, folder: str, skip: Iterable[str] = ()) -> dict[str, DataFrame]:
    """Every Parquet table of a folder by name, files and folders alike."""
    names = [n for n, _, size in list_folder(spark, folder) if n.endswith(".parquet") and size]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in names if n.removesuffix(".parquet") not in set(skip)}


def latest_snapshot(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Read the newest extract below a folder, chosen by folder name alone."""
    names = [n for n, is_folder, _ in list_folder(spark, folder) if is_folder and n.startswith(prefix)]
    if not names:
        raise FileNotFoundError(f"no snapshot below {folder}")
    return spark.read.option("basePath", folder).parquet(f"{folder}/{max(names)}")


def numbered_lines(spark: SparkSession, path: str, record_mark: str | None = None) -> DataFrame:
    """(file, line_no, value) of text records, line_no 1-based in each file.

    The position inside a file split comes from the split, whose size the reader bounds;
    the splits' record counts are summed up per file.
    """
    reader = spark.read if record_mark is None else spark.read.option("lineSep", record_mark)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_seen"))
    sizes = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "_block", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return lines.withColumn("_no", inside).join(sizes, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_no")).alias("line_no"), "value"
    )


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names, one per line of the sidecar file."""
    schema = T.StructType([T.StructField("name", T.StringType())])
    lines = spark.read.schema(schema).csv(path).withColumn("_seen", F.monotonically_increasing_id())
    return [r["name"] for r in lines.orderBy("_seen").collect()]


def delimited_export(
    spark: SparkSession,
    data_path: str,
    names: Sequence[str],
    field_mark: str = FIELD_MARK,
    record_mark: str = RECORD_MARK,
    quarantine: bool = False,
) -> DataFrame:
    """Latin-1 export with multi-character marks, all columns as text, blanks as null.

    Empty records are skipped. A record with another number of fields is an error; with
    ``quarantine`` those records are returned instead, with file and line number.
    """
    if quarantine:
        lines = numbered_lines(spark, data_path, record_mark)
    else:
        lines = spark.read.option("lineSep", record_mark).text(data_path).withColumn("file", F.col("_metadata.file_path"))
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = lines.withColumn("value", value).where(F.length("value") > 0)
    fields = lines.withColumn("_fields", F.split("value", re.escape(field_mark), -1))
    fits = F.size("_fields") == len(names)
    if quarantine:
        return fields.where(~fits).select("file", "line_no", F.size("_fields").alias("fields"), "value")
    message = F.concat(F.lit(f"expected {len(names)} fields in "), F.col("file"), F.lit(", record: "), F.col("value"))
    checked = F.when(fits, F.col("_fields")).otherwise(F.raise_error(message).cast("array<string>"))
    parts = fields.select(checked.alias("_fields"))
    return parts.select(*[blank_to_null(F.col("_fields")[i]).alias(n) for i, n in enumerate(names)])


def load_table(spark: SparkSession, name: str, folder: str) -> DataFrame | None:
    """``<name>.csv`` with header ``<name>_Headers.csv``; None when the data file is empty."""
    sizes = {n: size for n, _, size in list_folder(spark, folder)}
    if sizes[f"{name}.csv"] == 0:
        return None
    if sizes.get(f"{name}_Headers.csv", 0) == 0:
        raise ValueError(f"header file of {name} is empty")
    return delimited_export(spark, f"{folder}/{name}.csv", read_header(spark, f"{folder}/{name}_Headers.csv"))


def load_all_tables(spark: SparkSession, folder: str, skip: Iterable[str] = (), views: bool = True) -> dict[str, DataFrame]:
    """Every table of an export folder by name; also registered as temporary views."""
    names = sorted({n.split("_")[0].split(".")[0] for n, _, _ in list_folder(spark, folder) if n.endswith(".csv")})
    tables = {n: load_table(spark, n, folder) for n in names if n not in set(skip)}
    tables = {n: d for n, d in tables.items() if d is not None}
    if views:
        for n, d in tables.items():
            d.createOrReplaceTempView(n)
    return tables


def column_search(spark: SparkSession, tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Names of the tables that have a column containing a text, case ignored."""
    pairs = [(t, c) for t, d in tables.items() for c in d.columns]
    found = spark.createDataFrame(pairs, "table_name string, column_name string")
    return found.where(F.lower("column_name").contains(text.lower())).select("table_name").distinct()


def year_predicate(column: str, years: range | Sequence[int] | int | None) -> Column:
    """None = all; a range is inclusive of its stop; a scalar; a list."""
    if years is None:
        return F.lit(True)
    if isinstance(years, range):
        return F.col(column).between(years.start, years.stop)
    if isinstance(years, int):
        return F.col(column) == years
    return F.col(column).isin(list(years))


def document_scan(
    df: DataFrame, year: str, years, equal: Mapping[str, object] | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """Documents by year predicate and equality conditions, projected."""
    condition = year_predicate(year, years)
    for name, value in (equal or {}).items():
        condition = condition & (F.col(name) == F.lit(value))
    got = df.where(condition)
    return got.select(*columns) if columns else got


def map_fields(df: DataFrame, record: str, fields: Mapping[str, str]) -> DataFrame:
    """Typed columns out of a JSON or map record; ``fields`` maps a name to its type."""
    kind = df.schema[record].dataType
    entries = F.col(record) if isinstance(kind, T.MapType) else F.from_json(record, "map<string,string>")
    out = df.withColumn("_entries", entries)
    return out.withColumns({n: F.col("_entries")[n].try_cast(t) for n, t in fields.items()}).drop("_entries")


def keyed_upsert(old: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old rows replaced by the last batch row per key, plus the new keys."""
    newest = top_rows(batch, keys, [o[1:] if o.startswith("-") else f"-{o}" for o in order])
    kept = old.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest.select(*old.columns))


def bucketed_write(df: DataFrame, path: str, position: str, writers: int) -> None:
    """Write with exactly N concurrent writers, bucket = position modulo N."""
    if df.sparkSession.conf.get("spark.speculation", "false") == "true":
        raise RuntimeError("this sink is not idempotent: run it with spark.speculation=false")
    bucket = F.pmod(F.col(position), F.lit(writers)).cast("int")
    df.withColumn("bucket", bucket).repartitionById(writers, F.col("bucket")).write.mode("overwrite").parquet(path)


def file_write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Replace a CSV, JSON, ORC or Parquet folder."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def table_write(df: DataFrame, url: str, name: str, **options: str) -> None:
    """Replace a database table over JDBC."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()


def materialize(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    folder: str,
    mode: str = "enabled",
) -> DataFrame:
    """Run a builder once and read the stored result afterwards.

    enabled: use the stored table when present; disabled: recompute and store;
    bypass: compute without storing.
    """
    if mode not in ("enabled", "disabled", "bypass"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "bypass":
        return build()
    path = os.path.join(folder, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    stored = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if mode == "disabled" or not stored:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def n_line_records(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """Every len(fields) text lines become one record of typed columns."""
    n = len(fields)
    lines = numbered_lines(spark, path)
    at = lines.withColumns({"record": F.floor((F.col("line_no") - 1) / n), "_at": (F.col("line_no") - 1) % n})
    cells = {
        name: F.max(F.when(F.col("_at") == i, F.col("value"))).try_cast(kind) for i, (name, kind) in enumerate(fields.items())
    }
    return at.groupBy("file", "record").agg(*[c.alias(n) for n, c in cells.items()])
