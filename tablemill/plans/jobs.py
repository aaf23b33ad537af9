"""Complete jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions import numbers, text, times
from tablemill.modeling import evaluate, features, training
from tablemill.operators import aggregates, checks, columns, filters, joins, series, windows
from tablemill.session import settle
from tablemill.skew import attach, join_on_keys

# Measurements that stay on their own scale.
NOT_LOGGED = ("WQ_Alkalinity", "WQ_Fecal Coliforms", "WQ_Hardness", "WQ_Temperature", "WQ_Total Coliforms")
TEST_WORDS = ("test project", "ryan")
MUSIC_CATEGORY = 1


def chart(
    index: DataFrame, prior: DataFrame, exceptions: DataFrame, categories: DataFrame, names: DataFrame,
    metric: int, week: int, limit: int = 1500, below: float = 100.0,
) -> DataFrame:
    """Top entities of a week by their latest score, without entities already charted, excepted or of another category.

    ``index`` holds (entity_id, metric_id, count_type, unix_seconds, value), ``prior``
    (entity_id, week), ``exceptions`` (entity_id, active), ``categories`` (entity_id,
    category_id, rank_value, deleted_at) and ``names`` (entity_id, entity_name).
    """
    start, stop = week * times.WEEK - 3 * times.DAY, week * times.WEEK + 4 * times.DAY - 1
    wanted = filters.all_of(
        F.col("metric_id") == metric, F.col("unix_seconds").between(start, stop), F.col("count_type") == "d", F.col("value") < below
    )
    scores = windows.latest_per_group(index.where(wanted), ["entity_id", "metric_id"], ["unix_seconds", "value"]).select("entity_id", "value")
    no_week = F.lit(None).cast("long").alias("week")
    charted = aggregates.min_per_group(prior, ["entity_id"], "week", "week")
    excepted = exceptions.where(F.lower("active") == "no").select("entity_id", no_week).distinct()
    others = windows.top_category(categories, "entity_id", "category_id", "rank_value", "deleted_at", F.col("category_id") != MUSIC_CATEGORY)
    excluded = windows.union_all(charted, excepted, others.select("entity_id", no_week))
    kept = joins.exclusion_join(scores, excluded, "entity_id", "week", week)
    ranked = windows.global_rank(kept, ["-value", "-entity_id"], limit)
    return joins.inner(ranked, names, ["entity_id"]).withColumn("week_timestamp", F.lit(week))


def measurement_view(tests: DataFrame, projects: DataFrame, parameters: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """Latest cleaned measurements per distribution point, logged and benchmarked.

    ``tests`` holds (project, point, parameter, unit, value, date, <metadata>), ``projects``
    (project, project_name, point_name prefix columns, country).
    """
    point = ["project", "point"]
    clean = settle(columns.convert_parameter_units(tests.where(F.col("unit").isNotNull() & F.col("value").isNotNull())), "clean")
    single = settle(aggregates.upper_median_row(clean.drop("unit", "original_unit"), [*point, "parameter", "date"], "value", list(metadata), clean.count()), "single")
    typical = aggregates.mode_per_group(single, [*point, "date"], metadata)
    wide = series.pivot(single, [*point, "date"], "parameter", "value", parameters, "WQ_")
    joined = wide.join(typical, [*point, "date"]).join(projects, "project")
    named = joined.withColumn("identifier", text.point_label(F.col("project"), F.col("point"), F.col("project_name"), F.concat(F.lit("P"), F.col("point").cast("string"))))
    latest = windows.latest_per_group(named, ["identifier"], ["date"])
    logged = settle(columns.log_columns(latest, [f"WQ_{p}" for p in parameters if f"WQ_{p}" not in NOT_LOGGED]), "logged")
    values = [c for c in logged.columns if c.startswith("WQ_")]
    return aggregates.group_benchmark(logged.withColumn("organization", F.lit("all")), values, {"All": ["organization"], "Country": ["country"]})


def project_timeline_view(
    projects: DataFrame, timeline: DataFrame, static: Sequence[str], timed: Sequence[str], benchmarked: Sequence[str], test_words: Sequence[str] = TEST_WORDS
) -> DataFrame:
    """Static project data with its monthly figures, gaps filled, sums and benchmarks added.

    ``projects`` holds (id, name, country, ...), ``timeline`` (id, date, ...). Timeline rows
    of an unknown project are an error.
    """
    orphans = checks.missing_references(timeline, "id", projects, "id").limit(5).collect()
    if orphans:
        raise ValueError(f"timeline without project: {[r['id'] for r in orphans]}")
    joined = joins.full(projects, timeline, ["id"])
    real = settle(filters.exclude_containing(joined, "name", list(test_words)), "real")
    filled = series.monthly_reindex(real, "id", "date", static, timed)
    summed = settle(columns.add_calculated_sums(filled), "summed")
    return aggregates.group_benchmark(summed, list(benchmarked), {"All": ["date"], "Country": ["date", "country"]})


def training_matrix(
    tables: Mapping[str, DataFrame], ids: Sequence[str], games: DataFrame, ranks: DataFrame, response: str, top_share: float = 0.5, min_game: int = 8
) -> DataFrame:
    """One row per (game, player) with the response, the past of team, opponent and player, and strength-adjusted values.

    ``tables`` are raw statistics by type (``ids`` game, team, player, pos, then text columns),
    ``games`` holds one row per game and side (game, date, team, opponent, is_home) and
    ``ranks`` (damping, opponent, rank). Texts are parsed, players rolled up to teams, averages
    per past game taken of every statistic, of both sides, first and second degree. A
    player's averages are also weighted by the ranks of the opponents faced and put back on
    their scale by the rank of the coming opponent (``Player:<metric>:Adj:<damping>``).
    """
    long = series.metric_tables_union(tables, games.select("game", "date", "team", "opponent"), ["game", "team"], ids)
    stats = settle(long.withColumn("value", numbers.stat_number(F.col("metric"), F.col("value"))).where("value IS NOT NULL"), "stats")
    teams = settle(aggregates.metric_rollup(stats, ["date", "team", "opponent", "game", "pos"]), "teams")
    cells = joins.cell_names(teams)
    metrics = sorted({m for _, m in cells})

    numbered = windows.sequence_number(games.withColumn("year", F.year("date")), ["team", "year"], ["date", "opponent"], "game_number")
    results = stats.groupBy("date", "game", "team", "opponent", "player").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    results = settle(results, "results")
    rows = results.where(F.col(f"`{response}`").isNotNull()).join(numbered.select("game", "team", "game_number", "is_home"), ["game", "team"])
    rows = rows.where(F.col("game_number") >= min_game).select("game", "date", "team", "opponent", "player", "is_home", "game_number", F.col(f"`{response}`").alias("response"))
    rows = settle(filters.top_entities(settle(rows, "numbered"), "player", "response", top_share), "rows")

    # only (date, team) pairs of the rows are asked for
    asked = rows.select("date", "team").unionByName(rows.select("date", F.col("opponent").alias("team")))
    dampings = sorted(r[0] for r in ranks.select("damping").distinct().collect())  # a handful of damping factors
    faced = stats.groupBy("date", "game", "team", "opponent", "player", "metric").agg(F.sum("value").alias("value"))
    for d in dampings:
        faced = joins.lookup_with_default(faced.withColumn("damping", F.lit(d)), ranks.withColumnRenamed("rank", f"rank_{d}"), ["damping", "opponent"], ["damping"], "opponent", f"rank_{d}").drop("damping")
    past = joins.past_averages(
        rows.select("team", "player", "date").distinct(), faced, ["team", "player"], [(m,) for m in metrics], ["metric"], [f"rank_{d}" for d in dampings]
    )
    own = results.drop("opponent", "date")
    matrix = joins.game_context(rows, settle(joins.team_states(asked, teams, cells), "states"), past.withColumnRenamed("games", "ContribG"), own)
    for d in dampings:
        coming = joins.lookup_with_default(matrix.withColumn("damping", F.lit(d)), ranks.withColumnRenamed("rank", "_rank"), ["damping", "opponent"], ["damping"], "opponent", "_rank")
        adjusted = {f"Player:{m}:Adj:{d}": F.try_divide(F.col(f"`Player:{m}@rank_{d}`"), F.col("_rank")) for m in metrics}
        matrix = coming.withColumns(adjusted).drop("damping", "_rank", *[f"Player:{m}@rank_{d}" for m in metrics])
    derived = [{"op": "diff", "left": f"Team:{c}:1st", "right": f"Opp:{c}:1st", "result": f"Diff:{c}"} for c in map(":".join, cells)]
    return columns.add_binary_fields(matrix, derived)


def entity_feature_table(observations: DataFrame, entities: DataFrame, value: str = "value", limit: int = 4) -> DataFrame:
    """Per entity: distribution, threshold, range and bin features of an hourly series, with outcome readings.

    ``observations`` holds (uid, at, value), ``entities`` (uid, gos-*...). Times go to the
    nearest hour, the largest value of an hour stays, short gaps are filled.
    """
    hour = F.unix_seconds(times.round_time(F.col("at"), 3600))
    hourly = windows.first_per_group(observations.select("uid", hour.alias("second"), value), ["uid", "second"], "order", [f"-{value}"])
    hourly = settle(series.grid_interpolate(hourly, ["uid"], "second", value, 3600, limit), "hourly")
    since = attach(hourly, ["uid"], {"_first": F.min("second")}).withColumn("minute", (F.col("second") - F.col("_first")) / 60)
    parts = [
        aggregates.quantile_profile(since, ["uid"], value),
        aggregates.threshold_counts(since, ["uid"], value, under=[5, 10], over=[100]),
        aggregates.range_share(since, ["uid"], value, "minute", 4320, {"share_low": (0, 20), "share_middle": (20, 60), "share_high": (60, float("inf"))}),
        aggregates.binned_aggregate(since.where(F.col("minute") <= 4320), ["uid"], value, [1, 5, 20, 100, 1e9], "count", "right", "bin"),
    ]
    table = joins.full(entities, parts[0], ["uid"])
    for part in parts[1:]:
        table = table.join(part, "uid", "left")
    return columns.outcome_bins(table, "gos")


def source_merge(
    sources: Sequence[DataFrame], answers: DataFrame, tables: Mapping[str, DataFrame], key: str, kind: str, first: str, second: str, labels: str,
    max_null_share: float = 0.5, agree: Sequence[str] = (), max_column_nulls: float = 0.5,
) -> DataFrame:
    """Merge sources by preference, fill hidden answers, align feature tables, standardise and encode.

    Every source holds (key, kind, first, second, labels); ``answers`` fills ``first``. The
    ``agree`` columns of the feature tables must be the same in all tables that hold a key,
    else the merge is an error that shows some of them; they appear once in the result.
    Features that are null in more than ``max_column_nulls`` of the aligned rows are dropped,
    then rows in which more than ``max_null_share`` of the rest are null.
    """
    for c in agree:
        conflicts = checks.column_disagreements(tables, [key], c).limit(5).collect()
        if conflicts:
            raise ValueError(f"tables differ in {c}, for example for {[r[key] for r in conflicts]}")
    merged = joins.source_preference(sources, key)
    filled = joins.fill_from_answers(merged, answers, key, first)
    unique = checks.unique_rows(filled, [key])
    numeric = settle(joins.align_tables({n: d.drop(*agree) for n, d in tables.items()}, [key]), "aligned")
    numeric = filters.drop_sparse_columns(numeric, int(max_column_nulls * numeric.count()), [key])
    values = [c for c in numeric.columns if c != key]
    dense = filters.drop_sparse_rows(numeric, values, max_null_share)
    joined = joins.inner(unique, dense, [key])
    if agree:
        shared = windows.union_all(*[d.select(key, *agree) for d in tables.values()])
        joined = joined.join(shared.groupBy(key).agg(*[F.max(c).alias(c) for c in agree]), key)
    joined = settle(joined, "merged")
    joined = aggregates.response_standardise(joined, kind, first, second)
    scaled = features.apply_scaler(joined, features.fit_scaler(joined, values))
    return features.multi_value_one_hot(scaled, labels, features.multi_value_names(joined, labels)).drop(labels)


def call_classifier(calls: DataFrame, estimator: Callable[[], Estimator], folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Clean call records, encode them, classify business calls, describe minutes per predicted class.

    ``calls`` holds (id, business, day, clock, number, origin, minutes, fold). Returns the
    out-of-fold predictions and the summary.
    """
    clean = calls.select(
        "id", "minutes", "fold", F.col("business").cast("double").alias("business"),
        text.fill_category(text.last_token(F.col("origin"))).alias("state"),
        text.fill_category(text.token(F.col("number"), "-", 1)).alias("area"),
        times.clock_minutes(F.col("clock")).cast("double").alias("start"),
        F.dayofweek("day").cast("double").alias("weekday"),
    )
    for c in ("state", "area"):
        clean = features.encode_labels(clean, c, features.label_codes(clean, c), f"{c}_code")
    names = ["state_code", "area_code", "start", "weekday", "minutes"]
    clean = settle(clean, "calls")
    scored, _ = training.cv_train(clean, ["id"], names, ["business"], {"model": estimator}, "fold", folds)
    labelled = clean.join(scored.select("id", "label"), "id")
    return scored, aggregates.group_describe(labelled, ["label"], "minutes")


def evaluation_report(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], outcome: str, estimators: Mapping[str, Callable[[], Estimator]], fold: str, folds: int
) -> DataFrame:
    """Long report (section, model, item, value): scores, lift, importances and dependence of several models."""
    scored, models = training.cv_train(df, keys, names, [outcome], estimators, fold, folds, refit=True)
    scored = settle(scored, "predictions")
    spark = df.sparkSession

    def section(name: str, rows: DataFrame, item: str, value: str) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), "model", F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))

    quality = evaluate.binary_metrics(scored, ["model"]).unpivot(["model"], ["accuracy", "logloss", "roc_auc", "pr_auc"], "metric", "value")
    lift = evaluate.lift_gain(scored, ["model"], keys[0])
    weights = training.importance_table(models, names, spark)
    scaled = evaluate.normalize_importances(weights, ["task", "model"]).groupBy("model", "feature").agg(F.avg("value").alias("value"))
    report = section("score", quality, "metric", "value").unionByName(section("lift", lift, "prediction_group", "lift_model"))
    report = report.unionByName(section("importance", scaled, "feature", "value"))
    grid = training.dependence_grid(df, names[0], 10, (0.05, 0.95))
    for (name, i, _), model in models.items():
        if i == training.REFIT_FOLD:
            curve = training.partial_dependence(training.dependence_curves(training.predictor(model, names, True), df, keys, names[0], grid))
            report = report.unionByName(section("dependence", curve.withColumn("model", F.lit(name)), "grid", "prediction"))
    return report


def affinity(mentions: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Audience affinity of target pairs, counting every mention and counting each actor once."""
    args = ("actor", "target", "followers", first, second)
    every = aggregates.pair_affinity(mentions, *args)
    once = aggregates.pair_affinity(mentions, *args, distinct=True).withColumnRenamed("affinity", "unique_affinity")
    return join_on_keys(every, once, ["target_a", "target_b"])


def unstack(index: DataFrame, dimensions: Sequence[str] = (), pre_aggregated: Sequence[int] = ()) -> DataFrame:
    """Totals and deltas of every metric series."""
    return series.unstack_timeseries(index, dimensions, pre_aggregated)
