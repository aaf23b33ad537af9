"""Steps whose cost once grew faster than their rows; each test builds its own rows."""

import hashlib

import pytest
from pyspark.ml.clustering import LDAModel
from pyspark.sql import functions as F

from tablemill import skew
from tablemill.modeling import evaluate, features
from tablemill.operators import aggregates, columns, sampling


def test_topic_models_give_the_bound_without_a_pass_over_the_vocabulary_for_each_row(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(1), (F.col("id") % 7 + 2).cast("int")), lambda i: F.concat(F.lit("w"), (F.col("id") * i % 13 + F.when(F.col("id") % 2 == 0, 0).otherwise(9)).cast("string")))
    empty = F.array().cast("array<string>")
    terms = spark.range(120).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 11 == 0, empty).otherwise(words).alias("terms"))
    seen = []
    own = features.topic_likelihoods

    def watched(model, counted, group):
        seen.append((model.logLikelihood(counted.where("NOT apart")), model.logLikelihood(counted.where("apart"))))
        with monkeypatch.context() as m:
            m.setattr(LDAModel, "logLikelihood", None)
            return own(model, counted, group)

    monkeypatch.setattr(features, "topic_likelihoods", watched)
    quality, _, shares = features.topic_models(terms, "key", range(2, 4), top_words=3, iterations=3)
    rows = quality.orderBy("k").collect()
    apart = [r["key"] for r in terms.where(F.pmod(F.xxhash64("key"), F.lit(10)) == 0).select("key").collect()]
    held = terms.where(F.col("key").isin(apart)).agg(F.sum(F.size("terms"))).first()[0]
    assert [r["log_likelihood"] for r in rows] == pytest.approx([a for a, _ in seen], rel=1e-4)
    assert [r["held_out"] for r in rows] == pytest.approx([b / held for _, b in seen], rel=1e-4)
    assert [r["documents"] for r in rows] == [120, 120]
    assert shares.select("key").distinct().count() == 120


def counted_plans(monkeypatch, made):
    """Rows that windows over whole hot groups would number: what ``bucketed`` leaves to them."""
    kept = skew.numbered
    monkeypatch.setattr(skew, "numbered", lambda *a, **k: made.append(a) or kept(*a, **k))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_buckets_of_hot_groups_equal_those_of_numbered_rows(spark, monkeypatch, keys):
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 17)
    v = F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(9)).cast("double"))
    rows = spark.range(2000).select("id", k.alias("k"), v.alias("v"))
    tile = lambda no, n: F.floor((no - 1) * 7 / n)
    plain = sorted(map(repr, skew.bucketed(rows.select("*"), keys, ["-v", "id"], "tile", tile).collect()))
    made = []
    counted_plans(monkeypatch, made)
    spark.conf.set("tablemill.rowsPerSlice", "40")
    try:
        sliced = sorted(map(repr, skew.bucketed(rows.select("*"), keys, ["-v", "id"], "tile", tile).collect()))
    finally:
        spark.conf.unset("tablemill.rowsPerSlice")
    assert plain == sliced and not made


def test_fractions_and_lift_do_not_number_hot_groups(tiny_slices, monkeypatch):
    rows = tiny_slices.range(1000).select("id", F.lit("m").alias("model"), (F.col("id") % 7 * 1.0).alias("predicted"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("double").alias("actual"))
    made = []
    counted_plans(monkeypatch, made)
    for module in (sampling, evaluate):
        monkeypatch.setattr(module, "numbered", skew.numbered, raising=False)
    kept = {r["id"] for r in sampling.stratified_fraction(rows, "predicted", "id", 0.3, seed=2).collect()}
    lift = evaluate.lift_gain(rows, ["model"], "id", groups=7).orderBy("prediction_group").collect()
    assert not made
    order = sorted((i % 7, i) for i in range(1000))
    for t in range(10):
        tile = [i for no, (_, i) in enumerate(order) if no * 10 // 1000 == t]
        assert kept & set(tile) == set(sorted(tile, key=lambda i: (hashlib.md5(f"2:{i}".encode()).hexdigest(), i))[:30])
    best = sorted(range(1000), key=lambda i: (-(i % 7), i))
    known = [i % 2 for i in range(1000) if i % 5]
    for g, r in enumerate(lift):
        mine = best[g * 142 : (g + 1) * 142 if g < 6 else None]
        assert (r["prediction_group"], r["n"], r["model_count"]) == (g + 1, len(mine), sum(i % 2 for i in mine if i % 5))
        assert r["baseline_rate"] == pytest.approx(sum(known) / len(known))
    assert lift[-1]["n_cumulative"] == 1000


def test_slices_are_found_without_interpreted_lists(tiny_slices):
    """A list of cut points filtered by a lambda compared nested rows by building an ordering for each."""
    rows = tiny_slices.range(900).select("id", (F.col("id") % 5).alias("v"))
    plan = skew.numbered(rows, [], ["v", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_term_cells_are_read_back_not_made_anew(spark):
    docs = spark.range(60).select("id", F.concat(F.lit("all "), F.repeat(F.concat(F.lit("t"), F.chr(97 + F.col("id") % 5), F.lit(" ")), 2)).alias("text"))
    matrix = features.document_term_matrix(features.text_terms(docs, "id", "text", ["the"]), "id", 13)
    assert "regexp_replace" not in matrix._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["term"], r["n"]) for r in matrix.collect()) == [(i, "all", 1) for i in range(60)]


def test_groups_of_a_large_table_are_dealt_to_more_tasks_than_the_setting_has(spark, tmp_path):
    spark.range(3000).select((F.col("id") % 300).alias("k"), (F.col("id") * 7 % 11).alias("v"), "id").write.parquet(str(tmp_path / "t"))
    made = lambda: aggregates.upper_median_row(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", ["id"])
    plain = sorted(map(tuple, made().collect()))
    spark.conf.set("tablemill.rowsPerSlice", "200")
    try:
        got = made()
        assert "hashpartitioning(k" in got._jdf.queryExecution().executedPlan().toString() and ", 15)" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == plain
    finally:
        spark.conf.unset("tablemill.rowsPerSlice")


def test_rows_of_a_parameter_are_not_gathered_to_convert_units(spark):
    rows = spark.range(500).select(F.concat(F.lit("p"), F.col("id") % 3).alias("parameter"), F.lit("ppb").alias("unit"), F.col("id").cast("string").alias("value"))
    got = columns.convert_parameter_units(rows)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["value"] for r in got.collect()) == [i / 1000 for i in range(500)]
