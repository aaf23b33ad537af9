"""Nearest rows, as-of totals, correlations, fold sums, ranks and term counts against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemill.modeling import features, foldsums
from tablemill.operators import aggregates, joins, nearest, ranking
from tablemill.plans import jobs


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 20, (40, 5))
    points = (centers[rng.integers(0, 40, 9000)] + rng.normal(0, 0.5, (9000, 5))).round(2)
    points[4000:4050] = points[0]  # equal points: the smallest id counts
    rows = np.concatenate([points[:300], rng.normal(0, 30, (200, 5))])
    ids = rng.permutation(9000) + 5
    reference = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points)], "ref long, at array<double>").repartition(3)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rows)], "row long, x array<double>")
    got = {r["row"]: r for r in joins.nearest_row(df, "x", reference, "ref", "at").collect()}
    for i, p in enumerate(rows):
        gap = ((points - p) ** 2).sum(1)
        assert got[i]["nearest_id"] == ids[gap == gap.min()].min() and got[i]["distance"] == pytest.approx(np.sqrt(gap.min()))


def test_trees_rule_out_most_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (400, 3)) for c in rng.normal(0, 60, (10, 3))])
    tree = nearest.grow(points)
    tree |= {"points": points[tree["order"]], "ids": np.arange(len(points))[tree["order"]]}
    search = nearest.Search(points[::40] + 0.01)
    search.visit(tree)
    assert (search.id == ((points[None] - search.x[:, None]) ** 2).sum(2).argmin(1)).all()
    assert search.pairs < 0.1 * len(points) * len(search.x)
    same = nearest.grow(np.zeros((1000, 2)))
    assert len(same["radius"]) == 1


def test_nearest_of_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "was here") for r in rows], "row long, x array<double>, distance string")
    reference = spark.createDataFrame([(9, [0.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (7, None), (6, [float("nan"), 1.0])], "ref long, at array<double>")
    got = {r["row"]: (r["nearest_id"], r["distance"]) for r in joins.nearest_row(df, "x", reference, "ref", "at").collect()}
    assert got == {1: (8, 1.0), **{i: (None, None) for i in range(2, 8)}}
    none = joins.nearest_row(df, "x", reference.limit(0), "ref", "at").collect()
    assert len(none) == 7 and all(r["nearest_id"] is None for r in none)
    assert joins.nearest_row(df.limit(0), "x", reference, "ref", "at").count() == 0


@pytest.mark.parametrize("limit", ["2000000", "20"])
def test_totals_before_a_time(spark, limit):
    rng = np.random.default_rng(3)
    facts = pd.DataFrame({"k": rng.integers(0, 4, 400), "t": rng.integers(0, 50, 400), "v": rng.integers(0, 100, 400).astype(float)})
    asks = pd.DataFrame({"k": rng.integers(0, 6, 200), "t": rng.integers(0, 60, 200)}).drop_duplicates()
    spark.conf.set("tablemill.rowsPerSlice", limit)
    got = joins.expanding_totals(spark.createDataFrame(asks), spark.createDataFrame(facts), ["k"], "t", {"s": F.sum("v"), "n": F.count("v")}, fill=False).collect()
    spark.conf.unset("tablemill.rowsPerSlice")
    assert len(got) == len(asks)
    for r in got:
        past = facts[(facts.k == r["k"]) & (facts.t < r["t"])]
        assert (r["s"], r["n"]) == ((past.v.sum(), len(past)) if len(past) else (None, None))


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_with_and_without_nulls(spark, method):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"a": rng.integers(0, 9, 500).astype(float), "b": rng.normal(size=500), "c": 5.0})
    data["d"] = data.a * 3 + rng.normal(size=500)
    data["e"] = np.where(rng.random(500) < 0.3, np.nan, data.b + data.a)
    table = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)], "a double, b double, c double, d double, e double")
    got = {(r["a"], r["b"]): r["correlation"] for r in aggregates.correlation_matrix(table, list("abcde"), method).collect()}
    assert len(got) == 10
    for (x, y), r in got.items():
        both = data[[x, y]].dropna()
        both = both.rank() if method == "spearman" else both
        want = both[x].corr(both[y]) if both[x].std() * both[y].std() > 0 else np.nan
        assert r == pytest.approx(0.0 if np.isnan(want) else want, abs=1e-9)


def test_fold_sums_equal_separate_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 3, (300, 3))
    y, w, fold = x @ [0.5, -2.0, 0.1] + rng.normal(size=300), rng.integers(1, 4, 300).astype(float), rng.integers(0, 4, 300)
    table = spark.createDataFrame([(i, *map(float, r), float(v), float(k), int(f)) for i, (r, v, k, f) in enumerate(zip(x, y, w, fold))], "id long, a double, b double, c double, y double, w double, fold int")
    table = table.union(spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0, 0)], table.schema))  # a missing feature: no part of the fit, no prediction
    got, fits = foldsums.cv_least_squares(table, ["id"], ["a", "b", "c"], ["y"], "fold", 4, "w", refit=True)
    rows = {r["id"]: r for r in got.collect()}
    assert rows.pop(900)["predicted"] is None and len(rows) == 300
    for k in (0, 1, 2, 3, -1):
        train = fold != k
        design = np.column_stack([np.ones(train.sum()), x[train]]) * np.sqrt(w[train])[:, None]
        want = np.linalg.lstsq(design, y[train] * np.sqrt(w[train]), rcond=None)[0]
        assert fits["linear", k, "y"].slopes == pytest.approx(tuple(want[1:]), abs=1e-8)
        for i in np.flatnonzero(fold == k):
            assert rows[i]["predicted"] == pytest.approx(want[0] + x[i] @ want[1:], abs=1e-6)
    held = foldsums.fold_sums(table, ["a", "b", "c"], ["y"], "fold")
    fit = foldsums.solve(held, "y", (2,), 0.5)
    error = ((y - fit.intercept - x @ fit.slopes)[fold == 2] ** 2).sum()
    assert foldsums.squared_error(held, fit, "y", 2) == pytest.approx(error, rel=1e-6)
    with pytest.raises(ValueError):
        foldsums.predict_linear(fits, table, ["id"], ["a"], ["a", "b", "c"])


@pytest.mark.parametrize("undamped", [False, True])
def test_ranks_in_tasks_and_by_rounds(spark, undamped):
    rng = np.random.default_rng(6)
    games = [(k, int(a), int(b), float(rng.normal())) for k in range(2) for a in range(7) for b in rng.choice(7, 4, replace=False) if a != b]
    scores = spark.createDataFrame(games, "k int, team int, opponent int, score double")
    edges = ranking.transition_rows(scores, ["k"], damping=0.0 if undamped else 0.15)
    rank = lambda: {(r["k"], r["team"]): r["rank"] for r in ranking.stationary_rank(edges, ["k"], undamped=undamped).collect()}
    whole = rank()
    spark.conf.set("tablemill.rowsPerSlice", "3")
    rounds = rank()
    spark.conf.unset("tablemill.rowsPerSlice")
    assert whole.keys() == rounds.keys() and all(whole[i] == pytest.approx(rounds[i], abs=1e-8) for i in whole)
    assert sum(v for (k, _), v in whole.items() if k == 0) == pytest.approx(1)


def test_terms_counted_inside_the_row(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["a"]), (4, ["a", "a"])]
    terms = spark.createDataFrame(rows, "key long, terms array<string>")
    assert sorted(map(tuple, features.counted_terms(terms, "key").collect())) == [(1, "a", 1), (1, "b", 3), (4, "a", 1), (4, "a", 2)]
    assert sorted(map(tuple, features.term_counts(terms, "key").collect())) == [("a", 4, 3), ("b", 3, 1)]
    plan = features.term_counts(terms, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_merge_refuses_tables_that_disagree(spark):
    source = spark.createDataFrame([(1, "a", "1.0", 2.0, "x"), (2, "a", "2.0", 3.0, "y")], "id long, kind string, one string, two double, tags string")
    a = spark.createDataFrame([(1, 5, 1.0, None), (2, 6, 2.0, 3.0)], "id long, country long, n double, thin double")
    b = spark.createDataFrame([(1, 5, 4.0), (2, 6, 7.0)], "id long, country long, m double")
    answers = source.select("id", F.lit(1.0).alias("one"))
    merge = lambda other: jobs.source_merge([source], answers, {"a": a, "b": other}, "id", "kind", "one", "two", "tags", agree=["country"], max_column_nulls=0.4)
    got = merge(b)
    assert "a_thin" not in got.columns and sorted(r["country"] for r in got.collect()) == [5, 6]
    with pytest.raises(ValueError, match="country"):
        merge(b.withColumn("country", F.col("country") + 1))


def test_ranks_of_few_values_come_to_the_rows(spark):
    """Rows are not dealt out by a column of few values, whatever Spark thinks of the size of its ranks."""
    table = spark.range(500).selectExpr("CAST(id % 3 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = aggregates._ranked(table, ["a", "b"])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        rows = ranked.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert {(r["a"], r["_rank_a"]) for r in rows} == {(0.0, 84.0), (1.0, 251.0), (2.0, 417.5)}
    assert all(r["_rank_b"] == r["b"] + 1 for r in rows) and len(rows) == 500
