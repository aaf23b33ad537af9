"""Repeated ids, very deep pages, and languages that many documents share."""

import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tablemill.llm import extraction, langid, ngram  # noqa: E402

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
NEAR_B = B.replace("beta59", "other")


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    docs = spark.createDataFrame([(1, A), (1, B), (2, NEAR_B), (3, "something else entirely here")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in ngram.linked_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_no_text_goes_because_its_id_repeats(spark):
    rows = [(1, A), (1, B), (1, A), (2, NEAR_B), (3, "lone words that stand here alone"), (None, A), (4, "lone words that stand here alone")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == sorted([(False, 1, A), (False, 1, B), (False, 3, rows[4][1]), (True, 0, A)])


@pytest.mark.parametrize("page", ["<b>" * 16000 + "</i>" * 16000, "<i><table>" + "<b>" * 16000 + "</i>" * 16000, "<p><template>" + "<b>" * 8000 + "<p>" * 8000])
def test_deep_pages_are_parsed_in_linear_time(page):
    began = time.process_time()
    extraction.parse(page)
    assert time.process_time() - began < 2


def test_only_small_hashes_are_ranked_and_the_same_texts_learned(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort und mehr davon "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    picked = []
    for lang in ("de", "en"):
        picked += [r["doc_id"] for r in docs.where(F.col("lang") == lang).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(40).collect()]
    one, other = langid.train(docs, examples=40), langid.train(docs.where(F.col("doc_id").isin(picked)), examples=40)
    assert one.langs == other.langs and all((a == b).all() for a, b in zip(vars(one).values(), vars(other).values()) if hasattr(a, "shape"))
