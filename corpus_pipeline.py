"""Corpus preparation in five stages, each one operator of ``tablemill.llm``; a stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import decontam, langid, mixing, ngram, sharding
from tablemill.llm.common import word_count
from tablemill.session import settle

#: A document whose main language has a smaller share of its letters is rejected as a jumble.
MAIN_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null texts, no letters) and those in which no language prevails."""
    model = langid.train(docs)
    found = docs.select(F.struct("*").alias("doc"), langid.language(spark, "text", model).alias("found"))
    return found.filter((F.col("found.lang") != "und") & (F.col("found.score") >= MAIN_SHARE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Documents with fewer than five words link when they are equal. Where a doc_id repeats, every text under it is
    a document by itself, so that no text goes because of its id; of equal rows one stays. Null ids stay.
    """
    found = ngram.linked_components(docs, words=5, percent=80)
    if found.count() == docs.count():  # no doc_id repeats
        gone = found.filter("component_id <> id").select(F.col("id").alias("__gone"))
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("__key"), "doc_id", "text")
    rows = settle(rows, "rows")
    known = rows.filter("doc_id is not null")
    found = ngram.linked_components(known.select("__key", "text"), "__key", words=5, percent=80)
    texts = known.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.min("doc").alias("doc"))
    first = texts.join(found, texts["__key"] == found["id"]).groupBy("component_id").agg(F.min(F.struct("doc_id", "__key", "doc")).alias("first"))
    return first.select("first.doc.*").unionByName(rows.filter("doc_id is null").select("doc.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item (or a shorter item whole)."""
    rows = docs.select(F.struct("*").alias("doc"), "text")
    found = decontam.overlaps(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("overlap.ranges") == 0).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets; one at an edge may be cut."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count("text").alias("size"))
    return mixing.emit(mixing.mix(rows), "doc")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal all rows to eight shards uniformly; adds shard and slot."""
    return sharding.shuffle_shards(docs, ["doc_id", "text"])


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard),
]

#: The learned model and the seeded draws have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
