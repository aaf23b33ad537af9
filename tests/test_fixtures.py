"""Small inputs with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablemill.functions import numbers, text, times
from tablemill.modeling import evaluate
from tablemill.operators import aggregates, checks, columns, filters, joins, sampling, series, windows
from tablemill.operators.ranking import smallest_component, stationary_rank, transition_rows
from tablemill.sources import pages, tables

DAY = 86400
MAY1 = 1398902400


def metric_rows(spark, metric, kinds):
    out = []
    for kind in kinds:
        out += [(1, 1, metric, kind, MAY1 + d * DAY, float(v)) for d, v in [(0, 1), (1, 2), (2, 3), (5, 6), (6, 7), (7, 8)]]
    return spark.createDataFrame(out, "entity_id int, account_id int, metric_id int, count_type string, unix_seconds long, value double")


def unstacked(spark, metric, kinds):
    got = series.unstack_timeseries(metric_rows(spark, metric, kinds), pre_aggregated=[44, 42])
    return got.orderBy("unix_seconds").collect()


@pytest.mark.parametrize("metric", [11, 28])
def test_unstack_totals_only(spark, metric):
    rows = unstacked(spark, metric, "t")
    assert [r.total_value for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.delta_value for r in rows] == [1] * 7 + [None]
    assert [r.is_interpolated for r in rows] == [False] * 3 + [True] * 2 + [False] * 3


@pytest.mark.parametrize("metric", [133, 100])
def test_unstack_deltas_only(spark, metric):
    rows = unstacked(spark, metric, "d")
    assert len(rows) == 6 and sum(r.delta_value or 0 for r in rows) == 19
    assert all(r.total_value is None and r.is_interpolated is None for r in rows) and rows[-1].delta_value is None


@pytest.mark.parametrize("metric", [44, 42])
def test_unstack_pre_aggregated(spark, metric):
    rows = unstacked(spark, metric, "dt")
    assert [r.delta_value for r in rows] == [1, 2, 3, 6, 7, None]
    assert [r.total_value for r in rows] == [1, 2, 3, 6, 7, 8]


def test_unstack_guards(spark):
    with pytest.raises(ValueError):
        series.unstack_timeseries(metric_rows(spark, 11, "t").drop("value"))
    twice = metric_rows(spark, 11, "t").unionByName(metric_rows(spark, 11, "t"))
    with pytest.raises(Exception, match="several values"):
        series.unstack_timeseries(twice).collect()


def test_metric_rollup(spark):
    rows = []
    for player, ypa, att, yds, avg, ratt in (("a", 10, 1, 100, 10, 1), ("b", 20, 3, 50, 20, 3)):
        for m, v in (("passing:YPA", ypa), ("passing:Att", att), ("passing:Yds", yds), ("rushing:Avg", avg), ("rushing:Att", ratt), ("passing:Lg", yds)):
            rows.append(("g", player, m, float(v)))
    df = spark.createDataFrame(rows, "game string, player string, metric string, value double")
    got = {r.metric: r.value for r in aggregates.metric_rollup(df, ["game"]).collect()}
    assert got == {"passing:YPA": 17.5, "passing:Att": 4, "passing:Yds": 150, "rushing:Avg": 17.5, "rushing:Att": 4, "passing:Lg": 100}
    assert {r.metric: r.value for r in aggregates.metric_rollup(df, ["game"], "player_first").collect()}["passing:YPA"] == 30
    no_weight = df.where("metric <> 'passing:Att'")
    assert {r.metric: r.value for r in aggregates.metric_rollup(no_weight, ["game"]).collect()}["passing:YPA"] == 30
    with pytest.raises(ValueError):
        aggregates.metric_rollup(df, ["game"], "other")


def numbered_values(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")


@pytest.mark.parametrize(
    "values, answers",
    [
        ([], [None]), ([1], [(1, 1)]), ([1, 2, 2, 2, 2, 1], [(2, 4)]), ([1, 2, 2, 2, 8, 2, 7, 8, 8, 8, 8, 1], [(8, 5)]),
        ([1, 2, 2, 2, 3, 3, 3], [(3, 3), (2, 3)]), ([1, 2, 2, 5, 5, 5, 2, 2], [(2, 4)]),
    ],
)
def test_most_frequent(spark, values, answers):
    rows = aggregates.most_frequent(numbered_values(spark, values), [], "v").collect()
    assert (tuple(rows[0]) if rows else None) in answers


@pytest.mark.parametrize(
    "values, answers",
    [([], [None]), ([1], [(1, 1)]), ([1, 2, 2, 2, 3, 3], [(2, 3)]), ([1, 2, 2, 2, 3, 3, 3], [(2, 3)]), ([1, 2, 2, 5, 5, 5, 2, 2], [(5, 3)]), ([0, 0, 1], [(0, 2)])],
)
def test_longest_run(spark, values, answers):
    rows = aggregates.longest_run(numbered_values(spark, values), [], ["i"], "v").collect()
    assert (tuple(rows[0]) if rows else None) in answers


def test_nth_value(spark):
    df = numbered_values(spark, [5, 3, 9, 1])
    assert [windows.nth_value(df, "v", n).collect() for n in (1, 4)] == [[Row(v=1)], [Row(v=9)]]
    assert all(windows.nth_value(df, "v", n).isEmpty() for n in (-1, 0, 5, None))


def test_quarter_and_week_floor(spark):
    table = {
        "2015-12-31": "2015-10-01", "2016-01-01": "2016-01-01", "2016-03-31": "2016-01-01", "2016-04-01": "2016-04-01",
        "2016-05-01": "2016-04-01", "2016-06-30": "2016-04-01", "2016-07-01": "2016-07-01",
    }
    df = spark.createDataFrame([(k, v) for k, v in table.items()], "d string, q string").withColumn("d", F.to_date("d"))
    assert df.where(times.quarter_floor(F.col("d")).cast("string") != F.col("q")).isEmpty()
    weeks = df.select(times.week_floor(F.col("d")).alias("w"))
    assert weeks.where((times.week_floor(F.col("w")) != F.col("w")) | (F.weekday("w") != 0)).isEmpty()
    days = spark.createDataFrame([("2016-01-01",), ("2016-01-02",), ("2016-01-03",), ("2016-01-04",)], "d string")
    got = [r[0].isoformat() for r in days.select(times.business_floor(F.to_date("d"))).collect()]
    assert got == ["2016-01-01", "2016-01-01", "2016-01-01", "2016-01-04"]


def test_fixed_floor(spark):
    at = dt.datetime(2016, 1, 16, 4, 59, 59, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(at,)], "t timestamp")
    got = df.select(*[F.date_format(times.floor_time(F.col("t"), s), "dd HH:mm") for s in (DAY, 7200, 1800)]).first()
    assert tuple(got) == ("16 00:00", "16 04:00", "16 04:30")


def test_value_types(spark):
    df = spark.createDataFrame([("2", "x"), ("v", "y")], "x string, y string")
    assert [r.x for r in checks.type_offenders(df, "x", ["str"]).collect()] == ["2"]
    assert checks.type_offenders(df, "y", ["str"]).isEmpty()
    assert [r.x for r in checks.type_offenders(df, "x", ["int"]).collect()] == ["v"]


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_scalar_expressions(spark):
    lit = F.lit
    assert one(spark, numbers.first_number(lit("-8, 4"))) == 8 and one(spark, numbers.first_number(lit("-8.5"))) == -8.5
    assert one(spark, numbers.first_number(lit("none"))) is None
    for metric, noted, want in (("passing:Lg", "30t", 30), ("kicking:FG", "5/7", 5), ("x:y", "--", 0), ("kicking:Miss", "23,38", 2), ("x:y", "7.5", 7.5)):
        assert one(spark, numbers.stat_number(lit(metric), lit(noted))) == want
    assert one(spark, numbers.coerce_numeric(lit("1d"))) is None and one(spark, numbers.coerce_numeric(lit(" 1.5e2 "))) == 150
    assert one(spark, text.title_text(lit(" chlorine, FREE foo-bar "))) == "Chlorine, Free Foo-Bar"
    assert one(spark, times.clock_minutes(lit("02:05PM"))) == 125
    assert one(spark, numbers.sigmoid(lit(-800.0))) == 0 and one(spark, numbers.sigmoid(lit(800.0))) == 1
    assert one(spark, numbers.sigmoid(lit(None).cast("double"), 2.0)) is None
    assert one(spark, numbers.log10_value(lit(0.0))) == -math.inf
    assert one(spark, numbers.binned(lit(5.0), [0, 5, 10], "left")) == 1 and one(spark, numbers.binned(lit(5.0), [0, 5, 10], "right")) == 0
    with pytest.raises(Exception, match="unit not supported"):
        one(spark, numbers.to_litres(lit("1"), lit("barrels")))


def test_mixed_units_are_an_error(spark):
    df = spark.createDataFrame([("Lead", "mg/L", "1"), ("Lead", "Celsius", "2")], "parameter string, unit string, value string")
    with pytest.raises(Exception, match="several units"):
        columns.convert_parameter_units(df).collect()
    chlorine = spark.createDataFrame([("Chlorine, Free", "CFU/100ml", "1"), ("Chlorine, Free", "ppb", "500")], "parameter string, unit string, value string")
    assert sorted(r.value for r in columns.convert_parameter_units(chlorine).collect()) == [0.5, 1.0]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than one row"):
        columns.one_value(df, ["k"], "v").collect()
    with pytest.raises(ValueError):
        checks.require_unique(df, ["k"])
    with pytest.raises(Exception, match="repeats"):
        joins.left_enrich(df, df, ["k"], ["k"]).collect()
    with pytest.raises(Exception, match="several rows"):
        series.pivot(spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k int, c string, v int"), ["k"], "c", "v", ["a"]).collect()
    with pytest.raises(ValueError):
        columns.add_binary_fields(df, [{"op": "product", "left": "k", "right": "k", "result": "x"}])


def test_reports(spark):
    df = spark.range(10)
    kept, seen = filters.subset_with_report(df, F.col("id") < 4)
    assert kept.count() == 4 and seen.get == {"before": 10, "after": 4, "removed": 6, "removed_percent": 60.0}
    out, seen = columns.conditional_transform(df, "id", F.col("id") > 7, F.lit(0))
    assert out.agg(F.sum("id")).first()[0] == 28 and seen.get == {"changed": 2, "total": 10}


def test_truncate_after_event(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 0), (1, 3, 4), (2, 1, 0), (3, 1, 7)], "e int, t int, v int")
    assert {(r.e, r.t) for r in filters.truncate_after_event(df, "e", "t", "v", [1, 3]).collect()} == {(1, 1), (2, 1)}


def test_exclusion_join_keeps_later_weeks(spark):
    scores = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    gone = spark.createDataFrame([(2, None), (3, 10), (4, 12)], "id int, week int")
    assert {r.id for r in joins.exclusion_join(scores, gone, "id", "week", 10).collect()} == {1, 4}


def test_nearest_row_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x, refs = rng.normal(size=(60, 4)), rng.normal(size=(23, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)], "r int, c array<double>")
    want = ((x[:, None] - refs[None]) ** 2).sum(2).argmin(1).tolist()
    for block in (2000, 5):
        got = joins.nearest_row(df, "v", table, "r", "c", block).orderBy("i").collect()
        assert [r.nearest_id for r in got] == want


def test_beta_quantile_against_integration():
    grid = np.linspace(0, 1, 400_001)
    for a, b in ((1, 1), (2.5, 7), (40, 3), (300, 900)):
        with np.errstate(divide="ignore"):
            density = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid))
        density[~np.isfinite(density)] = 0
        share = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        want = np.interp(0.025, share / share[-1], grid)
        assert windows.beta_quantile(0.025, np.array([a]), np.array([b]))[0] == pytest.approx(want, abs=2e-5)


def test_beta_lower_bound(spark):
    df = spark.createDataFrame([("g", "e", d, 5.0, 10.0) for d in range(3)], "g string, e string, d int, v double, n double")
    rows = windows.beta_lower_bound(df, "g", "e", "d", "v", "n", rows=2).orderBy("d").collect()
    assert rows[0].alpha == 6 and rows[0].beta == 6 and rows[0].lower == pytest.approx(0.2338, abs=1e-3)
    assert rows[1].alpha == pytest.approx(1 + 0.2 * 10 + 0.8 * 5)


def test_since_last_event_and_nulls(spark):
    df = spark.createDataFrame([(i, e) for i, e in enumerate([False, True, False, False, True])], "i int, e boolean")
    assert [r.steps for r in windows.since_last_event(df, [], ["i"], "e").orderBy("i").collect()] == [None, 0, 1, 2, 0]
    with pytest.raises(Exception, match="must not be null"):
        windows.since_last_event(df.withColumn("e", F.when(F.col("i") > 1, F.col("e"))), [], ["i"], "e").collect()


def test_grid_interpolation(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 10, None), (1, 60, 12.0), (1, 65, 50.0), (1, 85, 9.0)], "k int, t long, v double")
    got = series.grid_interpolate(df, ["k"], "t", "v", 10, limit=2).orderBy("t").collect()
    assert [(r.t, r.v) for r in got] == [
        (0, 0.0), (10, 2.0), (20, 4.0), (30, None), (40, None), (50, None), (60, 12.0), (70, 12.0), (80, 12.0), (90, None),
    ]
    assert series.grid_interpolate(df, ["k"], "t", "v", 10, extend=False).count() == 9


def test_monthly_reindex_single_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, dt.date(2020, 1, 1), None), (2, dt.date(2020, 3, 1), "b")], "e int, m date, s string")
    got = {(r.e, r.m, r.s, r.interpolated) for r in series.monthly_reindex(df, "e", "m", ["s"]).collect()}
    assert got == {(1, None, "a", False), (2, dt.date(2020, 1, 1), "b", False), (2, dt.date(2020, 2, 1), "b", True), (2, dt.date(2020, 3, 1), "b", False)}
    with pytest.raises(Exception, match="null month"):
        series.monthly_reindex(df.withColumn("e", F.lit(1)), "e", "m", ["s"]).collect()


def test_folds_partition_entities(spark):
    df = spark.range(1000).withColumn("e", F.col("id") % 53)
    got = sampling.entity_folds(df, "e", 4, seed=3)
    assert got.count() == 1000 and got.groupBy("e").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r.n for r in got.select("e", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    assert sampling.bootstrap(df, "id", 3).groupBy("sample").count().where("count <> 1000").isEmpty()


def test_transition_rows_and_ranks(spark):
    scores = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 2.0), ("c", "a", 5.0), ("c", "b", 5.0)], "team string, opponent string, score double")
    rows = transition_rows(scores, damping=0.15)
    totals = rows.groupBy("team").agg((F.sum("weight") + F.max("base") * (3 - F.count("*"))).alias("t")).collect()
    assert all(r.t == pytest.approx(1) for r in totals)
    dense = {(x, y): None for x in "abc" for y in "abc"}
    for r in rows.collect():
        dense = {k: (r.weight if k == (r.team, r.opponent) else (dense[k] if dense[k] is not None else (r.base if k[0] == r.team else None))) for k in dense}
    m = np.array([[dense[x, y] for y in "abc"] for x in "abc"])
    v = np.full(3, 1 / 3)
    for _ in range(200):
        v = v @ m
    got = {r.team: r["rank"] for r in stationary_rank(rows).collect()}
    assert [got[t] for t in "abc"] == pytest.approx(v.tolist(), abs=1e-9)


def test_smallest_component(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c")]
    df = spark.createDataFrame([(x, y, 1.0, 0.0) for x, y in edges], "team string, opponent string, weight double, base double")
    assert {r.team for r in smallest_component(df).collect()} == {"a", "b"}
    ranks = {r.team: r["rank"] for r in stationary_rank(df, undamped=True).collect()}
    assert ranks == pytest.approx({"a": 0.5, "b": 0.5})


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 12, 200) / 12
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, actual double, predicted double")
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert evaluate.binary_metrics(df, ["model"]).first().roc_auc == pytest.approx(np.mean(wins))


def test_html_cells_and_lookup(spark):
    html = (
        "<p>x</p><table><tr><th>Reading<th>Actual<th>Average (5y)</tr><tr><td>Rain <a href='/r'>mm</a><a href='/z'>2</a></td><td>T 0</td><td>3.2 in</td></tr>"
        "<tr><td>Wind</td><td> - </td><td>12 mph</td></tr><tr><td>Snow</td><td>MM</td><td>1</td></tr></table>"
    )
    cells = pages.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).cache()
    first = cells.where("row_no = 1 AND col_no = 0").first()
    assert (first.text, first.href, first.is_header) == ("Rain mm2", "/r", False) and cells.count() == 12
    assert [pages.table_lookup(cells, n).first().value for n in ("Rain mm2", "Wind", "Snow")] == [0.0, 12.0, None]


def test_delimited_export(spark, tmp_path):
    (tmp_path / "Tests.csv").write_bytes("1|###|caf\xe9|:::|2|###| |:::||:::|".encode("latin-1"))
    (tmp_path / "Tests_Headers.csv").write_text("id\nname\n")
    (tmp_path / "Empty.csv").write_bytes(b"")
    (tmp_path / "Empty_Headers.csv").write_text("id\n")
    loaded = tables.load_all_tables(spark, str(tmp_path))
    assert set(loaded) == {"Tests"} and sorted(map(tuple, loaded["Tests"].collect())) == [("1", "café"), ("2", None)]
    (tmp_path / "Bad.csv").write_bytes(b"1|###|a|:::|2|:::|")
    with pytest.raises(Exception, match="expected 2 fields"):
        tables.delimited_export(spark, str(tmp_path / "Bad.csv"), ["id", "name"]).collect()
    bad = tables.delimited_export(spark, str(tmp_path / "Bad.csv"), ["id", "name"], quarantine=True).first()
    assert (bad.line_no, bad.fields, bad.value) == (2, 1, "2")


def test_materialize_modes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for mode, rows, made in (("enabled", 1, 1), ("enabled", 1, 1), ("bypass", 2, 2), ("enabled", 1, 2), ("disabled", 3, 3)):
        assert tables.materialize(spark, "t", build, str(tmp_path), mode).count() == rows and len(calls) == made


def test_line_records_across_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\nname {i}\n{i / 2}\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = tables.n_line_records(spark, str(path), {"id": "int", "name": "string", "half": "double"}).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.name, r.half) for r in got] == [(i, f"name {i}", i / 2) for i in range(400)]


def test_affinity_counts_repeats_unless_distinct(spark):
    rows = [("u", "a", 10), ("u", "a", 10), ("u", "b", 10), ("v", "b", 5)]
    df = spark.createDataFrame(rows, "actor string, target string, followers long")
    assert aggregates.pair_affinity(df, "actor", "target", "followers", ["a"], ["b"]).first().affinity == 20
    assert aggregates.pair_affinity(df, "actor", "target", "followers", ["a"], ["b"], distinct=True).first().affinity == 10
