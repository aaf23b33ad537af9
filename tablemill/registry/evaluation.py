"""Model evaluation.

The table operators read a prediction table derived from the orders (three scores per
order), so that SQL can check them; the fits read the labelled documents.
"""

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from tablemill.modeling import evaluate as ops
from tablemill.modeling import foldsums, training
from tablemill.operators.sampling import entity_folds
from tablemill.registry.base import query, r3, r6, table
from tablemill.session import settle


def _r6(df, *names):
    return df.withColumns({n: r6(F.col(f"`{n}`")) for n in names})


PREDS_SQL = """o AS (SELECT o_orderkey AS row, (o_orderkey % 3)::INT AS fold, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS actual, o_custkey, o_totalprice FROM orders),
preds AS (SELECT row, 'price' AS model, fold, actual, least(floor(o_totalprice / 5000) / 100, 1.0::DOUBLE) AS predicted FROM o
  UNION ALL SELECT row, 'customer', fold, actual, (o_custkey % 50) / 50.0::DOUBLE FROM o
  UNION ALL SELECT row, 'order', fold, actual, (row * 7 % 100) / 100.0::DOUBLE FROM o)"""


def predictions(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 3).cast("int").alias("fold"), (F.col("o_orderstatus") == "F").cast("double").alias("actual"),
        F.least(F.floor(F.col("o_totalprice") / 5000) / 100, F.lit(1.0)).alias("price"),
        ((F.col("o_custkey") % 50) / 50).alias("customer"), ((F.col("o_orderkey") * 7 % 100) / 100).alias("order"),
    )
    return o.unpivot(["row", "fold", "actual"], ["price", "customer", "order"], "model", "predicted")


@query("E03_prediction_table", f"WITH {PREDS_SQL} SELECT row, model, fold, R6(actual) AS actual, R6(predicted) AS predicted FROM preds")
def _(spark, sf):
    wide = predictions(spark, sf)
    by_model = {m: wide.where(F.col("model") == m).drop("model") for m in ("price", "customer", "order")}
    return _r6(ops.melt_predictions(by_model, ["row", "fold"], "actual", "predicted"), "actual", "predicted")


@query(
    "E04_score_by_fold",
    f"""WITH {PREDS_SQL}, s AS (SELECT model, fold::VARCHAR AS fold, avg((predicted >= 0.5)::INT = actual) AS accuracy, avg(predicted) AS mean FROM preds GROUP BY 1, 2
          UNION ALL SELECT model, 'All', avg((predicted >= 0.5)::INT = actual), avg(predicted) FROM preds GROUP BY 1)
        SELECT model, fold, 'accuracy' AS metric, R6(accuracy) AS value FROM s UNION ALL SELECT model, fold, 'mean', R6(mean) FROM s""".replace("avg((predicted >= 0.5)::INT = actual)", "avg(((predicted >= 0.5)::INT = actual)::INT)"),
)
def _(spark, sf):
    p = predictions(spark, sf)
    metrics = {"accuracy": F.avg(((F.col("predicted") >= 0.5).cast("int") == F.col("actual")).cast("int")), "mean": F.avg("predicted")}
    both = ops.scores(p, ["model", "fold"], metrics).unionByName(ops.scores(p, ["model", "fold"], metrics, pooled=True))
    return _r6(both, "value")


@query(
    "E05_regression_metrics",
    f"""WITH {PREDS_SQL} SELECT model, R6(avg((actual - predicted) * (actual - predicted))) AS mse, R6(sqrt(avg((actual - predicted) * (actual - predicted)))) AS rmse,
          R6(avg(abs(actual - predicted))) AS mae, R6(corr(actual, predicted) * corr(actual, predicted)) AS rsquared FROM preds GROUP BY 1""",
)
def _(spark, sf):
    metrics = ops.regression_metrics()
    return predictions(spark, sf).groupBy("model").agg(*[r6(m).alias(n) for n, m in metrics.items()])


CURVE_SQL = """t AS (SELECT model, predicted AS threshold, sum(actual) AS p, sum(1 - actual) AS n FROM preds GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS np, sum(n) OVER (PARTITION BY model) AS nn FROM t WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""


@query(
    "E06_binary_metrics",
    f"""WITH {PREDS_SQL}, {CURVE_SQL},
        s AS (SELECT model, avg(((predicted >= 0.5)::INT = actual)::INT) AS accuracy, -avg(actual * ln(greatest(least(predicted, 1 - 1e-15), 1e-15)) + (1 - actual) * ln(1 - greatest(least(predicted, 1 - 1e-15), 1e-15))) AS logloss FROM preds GROUP BY 1),
        q AS (SELECT *, tp / (tp + fp) AS prec, tp / np AS rec, lag(tp / (tp + fp)) OVER w AS prec0, lag(tp / np) OVER w AS rec0 FROM c WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)),
        a AS (SELECT model, sum(n * (tp - p / 2)) / max(np * nn) AS roc_auc, sum(coalesce((rec - rec0) * (prec + prec0) / 2, 0)) AS pr_auc FROM q GROUP BY 1)
        SELECT model, R6(accuracy) AS accuracy, R6(logloss) AS logloss, R6(roc_auc) AS roc_auc, R6(pr_auc) AS pr_auc FROM s JOIN a USING (model)""",
)
def _(spark, sf):
    return _r6(ops.binary_metrics(predictions(spark, sf), ["model"]), "accuracy", "logloss", "roc_auc", "pr_auc")


@query(
    "E07_multiclass_logloss",
    """SELECT R6(-avg(ln(greatest(least([0.5, 0.3, 0.2][k + 1] * (1 - w) + CASE WHEN k = g THEN w ELSE 0 END, 1 - 1e-15), 1e-15)))) AS logloss
       FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k, o_custkey % 3 AS g, (o_orderkey % 10) / 10.0::DOUBLE AS w FROM orders)""",
)
def _(spark, sf):
    k = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = (F.col("o_orderkey") % 10) / 10
    probs = F.array(*[p * (1 - w) + F.when(F.col("o_custkey") % 3 == i, w).otherwise(0.0) for i, p in enumerate((0.5, 0.3, 0.2))])
    o = table(spark, sf, "orders").select(k.alias("k"), probs.alias("p"))
    return o.agg(r6(ops.multiclass_log_loss(F.col("k"), F.col("p"))).alias("logloss"))


@query(
    "E08_confusion",
    f"""WITH {PREDS_SQL}, t AS (SELECT model, fold, count(*) FILTER (actual = 1 AND predicted >= 0.5)::DOUBLE AS tp, count(*) FILTER (actual = 0 AND predicted >= 0.5)::DOUBLE AS fp,
          count(*) FILTER (actual = 0 AND predicted < 0.5)::DOUBLE AS tn, count(*) FILTER (actual = 1 AND predicted < 0.5)::DOUBLE AS fn, count(*) AS n FROM preds GROUP BY 1, 2)
        SELECT model, fold, R6((tp + tn) / n) AS accuracy, R6(tp / (tp + fn)) AS sensitivity, R6(tn / (tn + fp)) AS specificity,
          R6(((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))) AS kappa, R6(100 * tp / n) AS tp_percent FROM t""",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("label", (F.col("predicted") >= 0.5).cast("int"))
    cells = ops.confusion(p, ["model", "fold"])
    both = ops.agreement(cells, ["model", "fold"]).join(cells.where("kind = 'TP'").select("model", "fold", F.col("percent").alias("tp_percent")), ["model", "fold"])
    return _r6(both, "accuracy", "sensitivity", "specificity", "kappa", "tp_percent")


@query(
    "E09_lift_gain",
    f"""WITH {PREDS_SQL}, r AS (SELECT model, actual, row_number() OVER (PARTITION BY model ORDER BY predicted DESC, row) AS no, count(*) OVER (PARTITION BY model) AS n, avg(actual) OVER (PARTITION BY model) AS rate FROM preds),
        g AS (SELECT model, (least((no - 1) // (n // 7), 6) + 1)::INT AS prediction_group, any_value(rate) AS baseline_rate, avg(actual) AS sensitivity, sum(actual) AS model_count, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT model, prediction_group, R6(baseline_rate) AS baseline_rate, R6(sensitivity) AS sensitivity, R6(model_count) AS model_count, n, R6(n * baseline_rate) AS baseline_count,
          R6(sensitivity / baseline_rate) AS lift_model, 1.0::DOUBLE AS lift_baseline, sum(n) OVER w::BIGINT AS n_cumulative, R6(sum(model_count) OVER w) AS gain_model, R6(sum(n * baseline_rate) OVER w) AS gain_baseline
        FROM g WINDOW w AS (PARTITION BY model ORDER BY prediction_group)""".replace("sum(n) OVER w::BIGINT", "CAST(sum(n) OVER w AS BIGINT)"),
)
def _(spark, sf):
    got = ops.lift_gain(predictions(spark, sf), ["model"], "row", groups=7)
    return _r6(got, "baseline_rate", "sensitivity", "model_count", "baseline_count", "lift_model", "gain_model", "gain_baseline")


@query("E10_roc_points", f"WITH {PREDS_SQL}, {CURVE_SQL} SELECT model, R6(threshold) AS threshold, R6(fp / nn) AS x, R6(tp / np) AS y FROM c")
def _(spark, sf):
    return _r6(ops.roc_points(predictions(spark, sf), ["model"]), "threshold", "x", "y")


IMPORTANCE_SQL = """imp AS (SELECT o_orderpriority AS feature, o_orderstatus AS model, (o_orderkey % 4)::INT AS fold, avg(o_totalprice) - 250000 AS value FROM orders GROUP BY 1, 2, 3)"""


def importances(spark, sf):
    o = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("model"), (F.col("o_orderkey") % 4).cast("int").alias("fold")
    )
    return o.agg((F.avg("o_totalprice") - 250000).alias("value"))


@query(
    "E12_importance_normalise",
    f"""WITH {IMPORTANCE_SQL}, a AS (SELECT feature, model, fold, abs(value) AS v FROM imp)
        SELECT feature, model, fold, R6(100 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)) AS minmax, R6((v - avg(v) OVER w) / stddev_samp(v) OVER w) AS zscore FROM a WINDOW w AS (PARTITION BY model)""",
)
def _(spark, sf):
    i = importances(spark, sf)
    a = ops.normalize_importances(i, ["model"]).withColumnRenamed("value", "minmax")
    b = ops.normalize_importances(i, ["model"], "zscore").withColumnRenamed("value", "zscore")
    return _r6(a.join(b, ["feature", "model", "fold"]), "minmax", "zscore")


@query(
    "E13_importance_weighted",
    f"""WITH {IMPORTANCE_SQL}, m AS (SELECT model, feature, median(value) AS v FROM imp GROUP BY 1, 2), u AS (SELECT model, feature, (v - min(v) OVER (PARTITION BY model)) / (max(v) OVER (PARTITION BY model) - min(v) OVER (PARTITION BY model)) AS u FROM m),
        s AS (SELECT model, median(n) AS s FROM (SELECT o_orderstatus AS model, o_orderkey % 4 AS fold, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1), w AS (SELECT model, s / sum(s) OVER () AS w FROM s)
        SELECT feature, R6(sum(u * w)) AS score FROM u JOIN w USING (model) GROUP BY 1""",
)
def _(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model"), (F.col("o_orderkey") % 4).alias("fold")).agg(F.count("*").cast("double").alias("value"))
    return _r6(ops.weighted_importances(importances(spark, sf), s), "score")


@query(
    "E14_importance_share_top",
    f"""WITH {IMPORTANCE_SQL}, s AS (SELECT model, feature, abs(value) / sum(abs(value)) OVER (PARTITION BY model, fold) AS s FROM imp),
        g AS (SELECT model, feature, avg(s) AS mean, stddev_samp(s) AS sd FROM s GROUP BY 1, 2)
        SELECT model, feature, R6(mean) AS mean, R6(sd) AS sd FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean DESC, feature) <= 3""",
)
def _(spark, sf):
    i = importances(spark, sf).withColumn("value", F.abs("value"))
    return _r6(ops.importance_shares(i, ["model"], 3), "mean", "sd")


@query(
    "E19_dependence_band",
    f"""WITH {PREDS_SQL} SELECT model, fold AS grid, R6(avg(predicted)) AS mean, R6(avg(predicted) - stddev_samp(predicted)) AS low, R6(avg(predicted) + stddev_samp(predicted)) AS high FROM preds GROUP BY 1, 2""",
)
def _(spark, sf):
    curves = predictions(spark, sf).select("model", F.col("fold").alias("grid"), F.col("predicted").alias("prediction"))
    return _r6(ops.dependence_band(curves, ["model", "grid"]), "mean", "low", "high")


@query(
    "E20_vote_average",
    f"""WITH {PREDS_SQL}, v AS (SELECT row, (predicted >= 0.5)::INT AS label, sum(CASE model WHEN 'price' THEN 1.5 ELSE 1 END) AS w FROM preds GROUP BY 1, 2),
        m AS (SELECT row, label AS majority FROM v QUALIFY row_number() OVER (PARTITION BY row ORDER BY w DESC, label) = 1)
        SELECT row, majority, R6(sum(predicted * CASE model WHEN 'price' THEN 2 ELSE 1 END) / 4) AS mean, R6(quantile_cont(predicted, 0.25)) AS low FROM preds JOIN m USING (row) GROUP BY 1, 2""",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("label", (F.col("predicted") >= 0.5).cast("int"))
    majority = ops.vote(p, ["row"], weights={"price": 1.5}).withColumnRenamed("label", "majority")
    mean = ops.average_prediction(p, ["row"], weights={"price": 2.0}).select("row", F.col("probability").alias("mean"))
    low = ops.average_prediction(p, ["row"], quantile=0.25).select("row", F.col("probability").alias("low"))
    return _r6(majority.join(mean, "row").join(low, "row"), "mean", "low")


@query(
    "E21_baseline_models",
    "SELECT p_partkey, R6(greatest(least((p_size - 10) / 30.0::DOUBLE, 1), 0)) AS probability, p_size AS itself, R6(0.25 * p_size + 0.75 * p_retailprice) AS average FROM part",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", r6(ops.baseline_probability((F.col("p_size") - 10) / 30)).alias("probability"), F.col("p_size").alias("itself"),
        r6(ops.baseline_average({"p_size": 0.25, "p_retailprice": 0.75})).alias("average"),
    )


@query(
    "E23_safe_predictions",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE 'O' END AS class, R6(CASE WHEN o_orderkey % 6 = 0 THEN 1 / 3.0::DOUBLE ELSE (o_orderkey % 6) / 10.0::DOUBLE END) AS p0 FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    first = F.when(k % 6 == 0, F.lit(float("nan"))).otherwise((k % 6) / 10)
    p = ops.safe_probabilities(F.array(first, F.lit(0.3), F.lit(0.2)), 3)
    return table(spark, sf, "orders").select("o_orderkey", ops.safe_class(F.when(k % 4 > 0, F.col("o_orderstatus")), "O").alias("class"), r6(p[0]).alias("p0"))


FOLD_SCORES_SQL = "s AS (SELECT model, fold, avg(((predicted >= 0.5)::INT = actual)::INT) AS accuracy, avg(abs(actual - predicted)) AS mae FROM preds GROUP BY 1, 2)"


def _fold_scores(spark, sf):
    metrics = {"accuracy": F.avg(((F.col("predicted") >= 0.5).cast("int") == F.col("actual")).cast("int")), "mae": F.avg(F.abs(F.col("actual") - F.col("predicted")))}
    return ops.scores(predictions(spark, sf), ["model", "fold"], metrics)


@query(
    "E24_resample_summary",
    f"WITH {PREDS_SQL}, {FOLD_SCORES_SQL} SELECT model, R6(avg(accuracy)) AS accuracy_mean, R6(stddev_samp(accuracy)) AS accuracy_sd, R6(avg(mae)) AS mae_mean, R6(stddev_samp(mae)) AS mae_sd FROM s GROUP BY 1",
)
def _(spark, sf):
    s = _fold_scores(spark, sf)
    got = ops.resample_summary({m: s.where(F.col("metric") == m) for m in ("accuracy", "mae")})
    return _r6(got, "accuracy_mean", "accuracy_sd", "mae_mean", "mae_sd")


@query(
    "E26_metric_slice",
    f"WITH {PREDS_SQL}, {FOLD_SCORES_SQL} SELECT model, fold::VARCHAR AS fold, 'mae' AS metric, R6(mae) AS value, R6(avg(mae) OVER (PARTITION BY model)) AS model_mean FROM s",
)
def _(spark, sf):
    return _r6(ops.metric_slice(_fold_scores(spark, sf), ["mae"]), "value", "model_mean")


# --- fits on the labelled documents ---

FEATURES = ["n_chars", "words", "lines", "digits"]


#: The same rows in SQL.
LABELLED_SQL = r"""lab AS (
  SELECT doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(len(string_split_regex(text, '\s+')) AS DOUBLE) AS words, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS lines,
         length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(length(text) AS DOUBLE) AS digits, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, 1.0::DOUBLE + toxic AS weight
  FROM documents AS d JOIN labels USING (doc_id)),
labelled AS (
  SELECT *, ((row_number() OVER (PARTITION BY quality ORDER BY md5('4:' || doc_id), doc_id) - 1) % 3)::INT AS fold FROM lab)"""


def labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.length("text")
    d = d.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.length(F.regexp_replace("text", r"\D", "")) / n).alias("digits"),
        F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), (1.0 + F.col("toxic")).alias("weight"),
    )
    return settle(entity_folds(d, "doc_id", 3, F.max("quality"), seed=4), "labelled")


def _classifiers():
    return {"tree": lambda: DecisionTreeClassifier(maxDepth=3, seed=1), "logistic": lambda: LogisticRegression(maxIter=10, regParam=0.01)}


def _least_squares_sql(outcomes, weight: str = "1", sets: str = "(VALUES (0), (1), (2)) AS v(i)", train: str = "fold <> i") -> str:
    """Predictions of all rows from each training set, by orthogonalising one feature after another.

    z1 is the first feature less its training mean, each later z the feature less its mean and
    its regressions on the z before it; the regression on all z is then one quotient for each.
    """
    w = f"CASE WHEN {train} THEN {weight} ELSE 0 END"
    sql = f"t0 AS (SELECT l.*, i, CAST({w} AS DOUBLE) AS w FROM labelled AS l, {sets})"
    for k, f in enumerate(FEATURES, 1):
        less = "".join(f" - z{j} * sum(w * z{j} * {f}) OVER s / sum(w * z{j} * z{j}) OVER s" for j in range(1, k))
        sql += f""", t{k} AS (SELECT *, {f} - sum(w * {f}) OVER s / sum(w) OVER s{less} AS z{k} FROM t{k - 1} WINDOW s AS (PARTITION BY i))"""
    for o in outcomes:
        terms = "".join(f" + z{j} * sum(w * z{j} * {o}) OVER s / sum(w * z{j} * z{j}) OVER s" for j in range(1, len(FEATURES) + 1))
        sql += f""", p_{o} AS (SELECT *, sum(w * {o}) OVER s / sum(w) OVER s{terms} AS predicted FROM t{len(FEATURES)} WINDOW s AS (PARTITION BY i))"""
    return sql


def _rounded(df):
    return df.withColumns({"actual": r3("actual"), "predicted": r3("predicted")})


@query(
    "E01_cv_train",
    f"""WITH {LABELLED_SQL}, {_least_squares_sql(["quality", "toxic"], "weight")}
       SELECT doc_id, 'linear' AS model, i AS fold, 'quality' AS task, R3(quality) AS actual, R3(predicted) AS predicted FROM p_quality WHERE fold = i
       UNION ALL SELECT doc_id, 'linear', i, 'toxic', R3(toxic), R3(predicted) FROM p_toxic WHERE fold = i""",
)
def _(spark, sf):
    got, _ = foldsums.cv_least_squares(labelled(spark, sf), ["doc_id"], FEATURES, ["quality", "toxic"], "fold", 3, weight="weight")
    return _rounded(got)


@query(
    "E02_predict_refit",
    f"""WITH {LABELLED_SQL}, {_least_squares_sql(["quality"], sets="(VALUES (-1)) AS v(i)", train="TRUE")}
       SELECT doc_id, 'linear' AS model, i AS fold, 'quality' AS task, R3(quality) AS actual, R3(predicted) AS predicted FROM p_quality""",
)
def _(spark, sf):
    d = labelled(spark, sf)
    _, fits = foldsums.cv_least_squares(d, ["doc_id"], FEATURES, ["quality"], "fold", 3, refit=True)
    return _rounded(foldsums.predict_linear(fits, d, ["doc_id"], FEATURES, FEATURES))


@query(
    "E11_importance_table",
    f"""WITH {LABELLED_SQL}, f AS (SELECT i, regr_slope(quality, words) AS b FROM labelled, (VALUES (0), (1), (2)) AS v(i) WHERE fold <> i GROUP BY 1)
       SELECT 'linear' AS model, i AS fold, 'quality' AS task, 'words' AS feature, R6(b) AS value FROM f""",
)
def _(spark, sf):
    _, fits = foldsums.cv_least_squares(labelled(spark, sf), ["doc_id"], ["words"], ["quality"], "fold", 3)
    return _r6(foldsums.coefficient_table(fits, ["words"], spark), "value")


RIDGES = [0.0, 0.01, 1.0, 100.0]


@query(
    "E15_grid_param_table",
    f"""WITH {LABELLED_SQL}, s AS (SELECT digits AS x, quality AS y, fold FROM labelled), g AS (SELECT unnest({RIDGES}::DOUBLE[]) AS ridge),
       m AS (SELECT o.i, n.j, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(y, x) AS c
             FROM s, (VALUES (0), (1), (2)) AS o(i), (VALUES (0), (1), (2)) AS n(j) WHERE o.i <> n.j AND fold <> o.i AND fold <> n.j GROUP BY 1, 2),
       e AS (SELECT i, ridge, sum((y - my - c / (vx + ridge) * (x - mx)) * (y - my - c / (vx + ridge) * (x - mx))) AS cost FROM m JOIN s ON fold = j, g GROUP BY 1, 2),
       b AS (SELECT i, arg_min(ridge, cost) AS ridge FROM (SELECT * FROM e ORDER BY ridge) GROUP BY 1)
       SELECT 'linear' AS model, 'ridge' AS variable, CAST(ridge AS VARCHAR) AS value, count(*) AS n FROM b GROUP BY ridge""",
)
def _(spark, sf):
    _, fits = foldsums.cv_least_squares(labelled(spark, sf), ["doc_id"], ["digits"], ["quality"], "fold", 3, ridges=RIDGES)
    return ops.parameter_counts(foldsums.ridge_table(fits, spark))


@query(
    "E27_multi_output_fit",
    f"""WITH {LABELLED_SQL}, {_least_squares_sql(["quality", "toxic"], sets="(VALUES (-1)) AS v(i)", train="TRUE")}
       SELECT doc_id, R3(q.predicted) AS quality_prediction, R3(t.predicted) AS toxic_prediction FROM p_quality AS q JOIN p_toxic AS t USING (doc_id)""",
)
def _(spark, sf):
    got, _ = foldsums.multi_output_linear(labelled(spark, sf), ["doc_id"], FEATURES, ["quality", "toxic"])
    return got.select("doc_id", r3("quality_prediction").alias("quality_prediction"), r3("toxic_prediction").alias("toxic_prediction"))


@query("E01_cv_models")
def _(spark, sf):
    got, _ = training.cv_train(labelled(spark, sf), ["doc_id"], FEATURES, ["quality", "toxic"], _classifiers(), "fold", 3, weight="weight")
    return got


@query("E02_refit_models")
def _(spark, sf):
    d = labelled(spark, sf)
    _, models = training.cv_train(d, ["doc_id"], FEATURES, ["quality"], _classifiers(), "fold", 1, refit=True)
    return training.predict_refit(models, d, ["doc_id"], FEATURES, FEATURES)


@query("E11_importance_models")
def _(spark, sf):
    _, models = training.cv_train(labelled(spark, sf), ["doc_id"], FEATURES, ["quality"], _classifiers(), "fold", 3)
    return training.importance_table(models, FEATURES, spark)


@query("E15_grid_param_models")
def _(spark, sf):
    def search():
        forest = RandomForestClassifier(numTrees=5, seed=1, labelCol="quality")
        grid = ParamGridBuilder().addGrid(forest.maxDepth, [2, 4]).build()
        return _Search(estimator=forest, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="quality"), seed=1)

    _, models = training.cv_train(labelled(spark, sf), ["doc_id"], FEATURES, ["quality"], {"forest": search}, "fold", 3)
    return ops.parameter_counts(training.grid_parameters(models, ["maxDepth"], spark))


class _Search(TrainValidationSplit):
    """Parameter search that takes its columns like a plain estimator."""

    def setFeaturesCol(self, name):
        self.getEstimator().setFeaturesCol(name)
        return self

    def setLabelCol(self, name):
        self.getEstimator().setLabelCol(name)
        return self


def _linear(spark, sf):
    i = table(spark, sf, "lineitem").select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"), "l_suppkey",
    )
    names = ["quantity", "discount", "tax"]
    model = LinearRegression(featuresCol="features", labelCol="price").fit(training.assemble(i, names))
    return i, names, model


@query(
    "E16_partial_dependence",
    """WITH s AS (SELECT regr_slope(l_extendedprice, l_linenumber) AS b, regr_intercept(l_extendedprice, l_linenumber) AS a, count(*) AS n FROM lineitem), g AS (SELECT DISTINCT l_linenumber AS g FROM lineitem)
       SELECT g::DOUBLE AS grid, round(a + b * g, 3) AS prediction, n FROM s, g""",
)
def _(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("no"), F.col("l_extendedprice").alias("price"))
    model = LinearRegression(featuresCol="features", labelCol="price", solver="normal").fit(training.assemble(i, ["no"]))
    grid = training.dependence_grid(i, "no")
    curves = training.dependence_curves(training.predictor(model, ["no"], False), i, [], "no", grid)
    return training.partial_dependence(curves).withColumn("prediction", F.round("prediction", 3))


@query("E17_univariate_dependence")
def _(spark, sf):
    i, names, model = _linear(spark, sf)
    grid = training.dependence_grid(i, "quantity", 20, (0.05, 0.95))
    return training.univariate_dependence(training.predictor(model, names, False), i, names, "quantity", grid)


@query("E18_ice_clusters")
def _(spark, sf):
    d = labelled(spark, sf)
    model = DecisionTreeClassifier(maxDepth=4, seed=1, featuresCol="features", labelCol="quality").fit(training.assemble(d, FEATURES))
    grid = training.dependence_grid(d, "words", 8, (0.1, 0.9))
    curves = training.dependence_curves(training.predictor(model, FEATURES, True), d, ["doc_id"], "words", grid)
    _, separating = training.ice_clusters(curves, d, "doc_id", grid, ["n_chars", "lines", "digits"], clusters=2)
    return separating


@query(
    "E22_entity_blend",
    """WITH o AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
            s AS (SELECT l_partkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT l_partkey, count(*) AS n, round(avg(CASE WHEN n > 25 THEN 0.25 * (o.a + o.b * l_quantity) + 0.75 * (s.a + s.b * l_quantity) ELSE o.a + o.b * l_quantity END), 2) AS blended
       FROM lineitem JOIN s USING (l_partkey), o GROUP BY 1""",
)
def _(spark, sf):
    i = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    model = LinearRegression(featuresCol="features", labelCol="price", solver="normal").fit(training.assemble(i, ["quantity"]))
    overall = training.predictor(model, ["quantity"], False)(i).drop("features")
    blend = training.entity_blend(overall, training.entity_linear_fits(i, "l_partkey", ["quantity"], "price"), "l_partkey", ["quantity"])
    return blend.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("blended"), 2).alias("blended"))


@query("E25_boosting_loss_curve")
def _(spark, sf):
    d = labelled(spark, sf)
    train, test = d.where("fold > 0"), d.where("fold = 0")
    model = GBTRegressor(featuresCol="features", labelCol="quality", maxIter=5, maxDepth=2, seed=1).fit(training.assemble(train, FEATURES))
    return training.boosting_losses(model, train.withColumn("label", F.col("quality")), test, FEATURES)


@query("E27_multi_output_models")
def _(spark, sf):
    got, _ = training.multi_output_fit(labelled(spark, sf), ["doc_id"], FEATURES, ["quality", "toxic"], lambda: DecisionTreeRegressor(maxDepth=3, seed=1))
    return got
