"""Sliced groups must give the rows of the plain window."""

import uuid

import pytest
from pyspark.sql import functions as F

from tablemill import skew
from tablemill.operators import aggregates, series, windows


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, heavy ties and nulls in the order columns."""
    base = spark.range(3000)
    return base.select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"),
        F.when(F.col("id") % 5 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(50))).alias("t"),
        F.when(F.col("id") % 4 > 0, F.pmod(F.xxhash64(F.col("id") + 1), F.lit(1000)).cast("double")).alias("v"),
        F.concat(F.lit("s"), (F.col("id") % 97).cast("string")).alias("s"),
    ).cache()


def both(spark, make):
    plain = sorted(map(repr, make().collect()))
    spark.conf.set("tablemill.rowsPerSlice", "40")
    try:
        sliced = sorted(map(repr, make().collect()))
    finally:
        spark.conf.unset("tablemill.rowsPerSlice")
    return plain, sliced


ORDERS = [["t", "id"], ["-t", "-id"], ["s", "id"], ["v", "-t", "id"]]


@pytest.mark.parametrize("order", ORDERS)
def test_running(spark, rows, order):
    wanted = {"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "seen": ("last", F.col("v"))}
    fresh = lambda: skew.running(rows.select("*"), ["k"], order, wanted)
    plain, sliced = both(spark, fresh)
    assert plain == sliced


@pytest.mark.parametrize("order", ORDERS)
def test_bounded(spark, rows, order):
    exprs = {
        "back": lambda w: F.lag("id", 3).over(w), "ahead": lambda w: F.lead("id", 2).over(w), "mean": lambda w: F.avg("v").over(w.rowsBetween(-3, 2)),
    }
    plain, sliced = both(spark, lambda: skew.bounded(rows.select("*"), ["k"], order, 3, 2, exprs))
    assert plain == sliced


def test_global_order(spark, rows):
    plain, sliced = both(spark, lambda: skew.numbered(rows.select("*"), [], ["t", "id"]))
    assert plain == sliced


def test_quantiles(spark, rows):
    shares = {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.975, "e": 1.0}
    for keys in ([], ["k"]):
        plain, sliced = both(spark, lambda: skew.quantiles(rows.select("*"), keys, "v", shares).select(*keys, *[F.round(c, 9) for c in shares]))
        assert plain == sliced


def test_attach_and_ranks(spark, rows):
    plain, sliced = both(spark, lambda: skew.attach(rows.select("*"), ["k"], {"m": F.max("v"), "n": F.count("v")}))
    assert plain == sliced
    plain, sliced = both(spark, lambda: skew.tie_ranks(rows.select("*"), ["k"], "t"))
    assert plain == sliced


def test_operators_on_hot_groups(spark, rows):
    ordered = rows.where("t IS NOT NULL")
    for make in (
        lambda: aggregates.longest_run(ordered.select("*"), ["k"], ["t", "id"], "s"),
        lambda: aggregates.upper_median_row(ordered.where("v IS NOT NULL"), ["k"], "v", ["id"]),
        lambda: windows.fill_gaps(ordered.select("*"), ["k"], ["t", "id"], ["s"], ["v"]),
        lambda: windows.trailing_sum_ewma(ordered.select("*"), ["k"], ["t", "id"], "v", 5).select("id", F.round("smooth", 9)),
        lambda: windows.lag_window_aggregate(ordered.select("*"), ["k"], ["t", "id"], ["v"], [(1, 3)], fill="backfill"),
    ):
        plain, sliced = both(spark, make)
        assert plain == sliced


def test_unstack_on_hot_series(spark):
    points = spark.range(500).select(
        F.lit(1).alias("entity_id"), F.lit(2).alias("account_id"), F.lit("t").alias("count_type"), F.lit(3).alias("metric_id"),
        (F.col("id") * 86400 * (1 + F.col("id") % 3)).alias("unix_seconds"), (F.col("id") * 1.5).alias("value"),
    ).dropDuplicates(["unix_seconds"])
    plain, sliced = both(spark, lambda: series.unstack_timeseries(points.select("*")))
    assert plain == sliced


def jobs(spark, work):
    """Number of jobs that building a plan runs."""
    group = f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys_are_sought_once(tiny_slices, rows):
    df = rows.select("*")
    first, out = jobs(tiny_slices, lambda: skew.numbered(df, ["k"], ["t", "id"]))
    assert first >= 1
    again, found = jobs(tiny_slices, lambda: skew.slicing(out, ["k"], ["t", "id"]))
    assert again == 0 and (0,) in found.keys
    back, turned = jobs(tiny_slices, lambda: skew.slicing(out, ["k"], ["-t", "-id"]))
    assert back == 0 and turned.backward and turned.cuts == found.cuts
    tiny_slices.conf.set("tablemill.rowsPerSlice", "5000")
    assert skew.slicing(out, ["k"], ["t", "id"]) is None
    tiny_slices.conf.set("tablemill.rowsPerSlice", "40")


def test_unstack_looks_for_hot_series_once(tiny_slices):
    points = tiny_slices.range(500).select(
        (F.col("id") % 2).alias("entity_id"), F.lit(2).alias("account_id"), F.lit("t").alias("count_type"), F.lit(3).alias("metric_id"),
        (F.col("id") * 86400).alias("unix_seconds"), (F.col("id") * 1.5).alias("value"),
    )
    looks = []
    sampled, skew._sampled_cuts = skew._sampled_cuts, lambda *a: looks.append(a) or sampled(*a)
    try:
        series.unstack_timeseries(points)
    finally:
        skew._sampled_cuts = sampled
    assert len(looks) == 1


def test_slices_are_balanced_and_follow_the_order(spark, rows):
    spark.conf.set("tablemill.rowsPerSlice", "8")
    try:
        cuts = skew.slicing(rows.select("*"), ["k"], ["-t", "s", "id"])
        assert max(map(len, cuts.cuts)) > skew.FAN  # two levels of the search tree
        parts = skew._sliced(rows.select("*"), ["k"], ["-t", "s", "id"], cuts).where("_hot")
        got = parts.select("k", "_slice", skew.sort_tuple(parts, ["-t", "s", "id"]).alias("at")).groupBy("k", "_slice").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        got = sorted(got.collect(), key=lambda r: (r["k"], r["_slice"]))
    finally:
        spark.conf.unset("tablemill.rowsPerSlice")
    assert max(r["n"] for r in got) <= 8
    assert all(a["high"] < b["low"] for a, b in zip(got, got[1:]) if a["k"] == b["k"])


KINDS = {
    "text": "concat('s', cast(id * 37 % 101 as string), repeat('x', cast(id % 3 as int)))", "flag": "id % 2 = 0", "whole": "(id * 7919) % 211 - 100", "small": "cast(id % 50 as smallint)",
    "real": "case when id % 13 = 0 then double('NaN') when id % 17 = 0 then double('-Infinity') else (id * 31 % 97) / 7.0 end", "day": "date_add(date'2020-01-01', cast(id % 90 as int))",
    "time": "timestamp_seconds(id * 7777 % 100000)", "clock": "cast(timestamp_seconds(id * 7777 % 100000) as timestamp_ntz)", "money": "cast((id * 13 % 71) as decimal(12, 2))", "bytes": "cast(cast(id * 37 % 101 as string) as binary)",
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("sign", ["", "-"])
def test_every_sort_type_in_both_directions(spark, kind, sign):
    table = spark.range(600).selectExpr("0 as k", "id", f"case when id % 9 = 0 then null else {KINDS[kind]} end as o", "case when id % 4 > 0 then id end as v")
    order = [f"{sign}o", "id"]
    wanted = {"n": ("count", F.lit(1)), "seen": ("last", F.col("v"))}
    plain, sliced = both(spark, lambda: skew.running(table.select("*"), ["k"], order, wanted))
    assert plain == sliced
    plain, sliced = both(spark, lambda: windows.fill_gaps(table.select("*"), ["k"], order, ["v"]))
    assert plain == sliced


def test_lookup_of_a_value_on_nine_rows_in_ten(spark):
    table = spark.range(2000).selectExpr("id", "case when id % 10 > 0 then 5 when id % 30 = 0 then null else id end as v")
    for make in (
        lambda: skew.lookup(table.select("*"), table.groupBy("v").agg(F.count("*").alias("n")), ["v"]), lambda: windows.percent_rank_average(table.select("*"), [], "v"),
        lambda: windows.percentile_bucket(table.select("*"), [], "v", 4), lambda: windows.distinct_per_entity(table.select("*"), "v", "id"), lambda: skew.attach(table.select("*"), ["v"], {"m": F.max("id")}),
    ):
        plain, sliced = both(spark, make)
        assert plain == sliced and len(plain) == 2000
    spark.conf.set("tablemill.rowsPerSlice", "40")
    plan = windows.percent_rank_average(table.select("*"), [], "v")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("tablemill.rowsPerSlice")
    assert "broadcast" in plan


def test_texts_with_a_common_beginning_keep_their_order(spark):
    spark.conf.set("tablemill.rowsPerSlice", "500")
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.format_string("Customer#%09d", "id").alias("name"), (-F.col("id")).alias("o"))
    got = skew.numbered(rows, ["k"], ["name", "o"], "n").collect()
    spark.conf.unset("tablemill.rowsPerSlice")
    assert sorted((r["name"], r["n"]) for r in got) == [(f"Customer#{i:09d}", i + 1) for i in range(4000)]


def test_last_with_falling_nullable_order(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 3 > 0, F.col("id") * 7 % 1000).alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    plain = {r["id"]: r["x"] for r in skew.running(rows, ["k"], ["-t", "-id"], {"x": ("last", F.col("v"))}).collect()}
    spark.conf.set("tablemill.rowsPerSlice", "300")
    other = rows.withColumn("again", F.lit(1))
    sliced = {r["id"]: r["x"] for r in skew.running(other, ["k"], ["-t", "-id"], {"x": ("last", F.col("v"))}).collect()}
    spark.conf.unset("tablemill.rowsPerSlice")
    assert sliced == plain


def test_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from tablemill.session import shared_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        shared_folder(cluster)
    assert shared_folder(spark)


def smooth_by_hand(values, rate):
    out, z = [], None
    for x in values:
        if x is not None:
            z = x if z is None else rate * x + (1 - rate) * z
        out.append(z)
    return out


@pytest.mark.parametrize("rate", [0.0, 1e-6, 0.2, 0.9, 1.0])
def test_smoothing_plain_and_sliced(spark, rate):
    table = spark.range(1500).selectExpr("case when id % 3 > 0 then 0 else id % 11 end as k", "id", "(id * 37) % 501 as t", "case when id % 7 > 0 and id > 60 then double(id * 13 % 97) end as v")
    rows = sorted(table.collect(), key=lambda r: (r["k"], -r["t"], r["id"]))
    want = {}
    for k in {r["k"] for r in rows}:
        mine = [r for r in rows if r["k"] == k]
        want |= {r["id"]: z for r, z in zip(mine, smooth_by_hand([r["v"] for r in mine], rate))}
    for limit in ("2000000", "40", "3"):
        spark.conf.set("tablemill.rowsPerSlice", limit)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        got = {r["id"]: r["z"] for r in windows.smoothed(table.select("*"), ["k"], ["-t", "id"], {"z": "v"}, rate).collect()}
        spark.conf.unset("tablemill.rowsPerSlice")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] - want[i]) < 1e-9) for i in want)
    with pytest.raises(ValueError):
        windows.smoothed(table, ["k"], ["t"], {"z": "v"}, 1.5)
