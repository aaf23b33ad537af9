"""Feature preparation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, NGram, RFormula, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import settle
from tablemill.skew import attach, join_on_keys, lookup, numbered, quantiles, top_rows


def mean_impute(df: DataFrame, columns: Sequence[str], indicators: bool = True) -> DataFrame:
    """Missing values take the column mean; ``<name>:ind`` marks them where a column has any."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns]).first()
    new: dict[str, Column] = {}
    for c in columns:
        if stats[f"n_{c}"]:
            if indicators:
                new[f"{c}:ind"] = F.col(c).isNull().cast("int")
            new[c] = F.coalesce(F.col(c).cast("double"), F.lit(stats[f"m_{c}"]))
    return df.withColumns(new) if new else df


def group_impute(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Missing values take the mean of their group."""
    out = attach(df, list(group), {"_mean": F.avg(column)})
    return out.withColumn(column, F.coalesce(F.col(column), F.col("_mean"))).drop("_mean")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample sd per column, nulls skipped; reusable on other tables."""
    aggs = [f(c).alias(f"{t}_{c}") for c in columns for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def apply_scaler(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in scaler.items()})


def one_hot(df: DataFrame, column: str, values: Sequence, name: str | None = None) -> DataFrame:
    """Indicator columns ``<name>.<value>``."""
    return df.withColumns({f"{name or column}.{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def multi_value_names(df: DataFrame, column: str, delimiter: str = ",") -> list[str]:
    """Sorted distinct items of a multi-valued text; they become columns, so they must be few."""
    items = df.select(F.explode(F.split(column, delimiter)).alias("v")).select(F.trim("v").alias("v")).distinct()
    return [r["v"] for r in items.where("v <> ''").orderBy("v").collect()]


def multi_value_one_hot(df: DataFrame, column: str, values: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Indicators ``<column>:<value>`` of a text such as ``a,b``; null gives all 0. No shuffle."""
    parts = F.transform(F.split(column, delimiter), lambda x: F.trim(x))
    return df.withColumns({f"{column}:{v}": F.coalesce(F.array_contains(parts, v).cast("int"), F.lit(0)) for v in values})


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, drop_zero: bool = True) -> DataFrame:
    """Powers ``a^2`` and interactions ``a x b`` up to a degree; all-zero ones are dropped."""
    new: dict[str, Column] = {}
    for size in range(2, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, size):
            powers = [(c, combo.count(c)) for c in dict.fromkeys(combo)]
            name = " x ".join(c if p == 1 else f"{c}^{p}" for c, p in powers)
            value = F.lit(1.0)
            for c in combo:
                value = value * F.col(c)
            new[name] = value
    out = df.withColumns(new)
    if drop_zero and new:
        seen = out.agg(*[F.max((F.col(f"`{n}`") != 0).cast("int")).alias(f"_{i}") for i, n in enumerate(new)]).first()
        out = out.drop(*[n for i, n in enumerate(new) if not seen[f"_{i}"]])
    return out


def formula_text(outcome: str, terms: Sequence[str], add: Sequence[str] = (), subtract: Sequence[str] = ()) -> str:
    kept = [t for t in [*terms, *add] if t not in subtract]
    return f"{outcome} ~ {' + '.join(dict.fromkeys(kept))}"


def design_matrix(df: DataFrame, formula: str, keep: Sequence[str]) -> DataFrame:
    """(keep, label, x): design matrix of an R-style formula, x as an array."""
    model = RFormula(formula=formula, featuresCol="_x", labelCol="label").fit(df)
    return model.transform(df).select(*keep, "label", vector_to_array("_x").alias("x"))


def label_codes(train: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    """(value, code): codes 0.. of the sorted training values and the unknown label."""
    extra = train.sparkSession.createDataFrame([(unknown,)], "value string")
    values = train.select(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).unionByName(extra).distinct()
    return numbered(values, [], ["value"], "_no").select("value", (F.col("_no") - 1).alias("code"))


def encode_labels(df: DataFrame, column: str, codes: DataFrame, name: str, unknown: str = "Unknown") -> DataFrame:
    """Code of each value; values the training never saw get the unknown code."""
    fallback = codes.where(F.col("value") == unknown).select("code").scalar()
    got = df.join(codes.select(F.col("value").alias(column), F.col("code").alias(name)), column, "left")
    return got.withColumn(name, F.coalesce(F.col(name), fallback))


def f_scores(df: DataFrame, features: Sequence[str], outcome: str, kind: str = "regression") -> DataFrame:
    """(feature, f): univariate F statistic of each feature.

    regression: r^2 / (1 - r^2) * (n - 2). classification: between over within class variance.
    """
    if kind == "regression":
        wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(F.col(f).cast("double"), F.col(outcome).cast("double")).alias(f"_{i}") for i, f in enumerate(features)])
        rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("r")) for i, f in enumerate(features)])
        return wide.select("_n", F.inline(rows)).select("feature", F.try_divide(F.col("r") ** 2 * (F.col("_n") - 2), 1 - F.col("r") ** 2).alias("f"))
    cells = df.select(outcome, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([outcome], list(features), "feature", "v")
    groups = cells.groupBy("feature", outcome).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    total = groups.groupBy("feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("sm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("s")).alias("within"),
    )
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("N")
    return total.select("feature", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k"))).alias("f"))


def k_best(df: DataFrame, features: Sequence[str], outcome: str, k: int, kind: str = "regression") -> DataFrame:
    """The k features with the largest F (all of them when k is larger)."""
    return top_rows(f_scores(df, features, outcome, kind).where("f IS NOT NULL"), [], ["-f", "feature"], min(k, len(features)))


def select_for_outcomes(df: DataFrame, features: Sequence[str], outcomes: Sequence[str], k: int, how: str = "any", kind: str = "regression") -> list[str]:
    """Features chosen for any (or all) outcomes; choosing none is an error."""
    chosen = [{r["feature"] for r in k_best(df, features, o, k, kind).collect()} for o in outcomes]
    kept = set.union(*chosen) if how == "any" else set.intersection(*chosen)
    if not kept:
        raise ValueError("no feature selected")
    return [f for f in features if f in kept]


def pca_model(df: DataFrame, columns: Sequence[str], k: int):
    """Fitted pipeline: assemble, scale, project onto k components (column ``pca``)."""
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="_scaled", outputCol="pca"),
    ]
    return Pipeline(stages=stages).fit(df)


def explained_variance(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(component, share) of the principal components of the scaled columns."""
    shares = pca_model(df, columns, k).stages[-1].explainedVariance.toArray()
    return df.sparkSession.createDataFrame([(i + 1, float(s)) for i, s in enumerate(shares)], "component int, share double")


def percentile_label(df: DataFrame, column: str, p: float, name: str = "label") -> DataFrame:
    """1 where the value exceeds its p-quantile, else 0."""
    cut = quantiles(df, [], column, {"_cut": p}).scalar()
    return df.withColumn(name, (F.col(column) > cut).cast("int"))


def text_terms(df: DataFrame, key: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(key, terms): lower-case words without digits, punctuation and stop words."""
    plain = F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\p{N}]", "")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 0)
    split = df.select(key, words.alias("_words"))
    remover = StopWordsRemover(inputCol="_words", outputCol="terms", stopWords=list(stop_words), caseSensitive=True)
    return remover.transform(split).select(key, "terms")


def bigrams(terms: DataFrame, key: str) -> DataFrame:
    """(key, terms) of neighbouring word pairs."""
    return NGram(n=2, inputCol="terms", outputCol="_pairs").transform(terms).select(key, F.col("_pairs").alias("terms"))


def counted_terms(terms: DataFrame, key: str) -> DataFrame:
    """(key, term, n): occurrences of each term of a row, counted inside the row, so nothing is shuffled.

    Equal terms lie together in the sorted list; where each begins and where the next begins give its count.
    """
    lists = terms.select(key, F.sort_array(F.coalesce("terms", F.array().cast("array<string>"))).alias("_all"))
    begins = F.filter(F.transform("_all", lambda t, i: F.when((i == 0) | (t != F.get("_all", i - 1)), i)), lambda i: i.isNotNull())
    marked = lists.select(key, "_all", begins.alias("_at"))
    cells = F.transform("_at", lambda b, i: F.struct(F.get("_all", b).alias("term"), (F.coalesce(F.get("_at", i + 1), F.size("_all")) - b).cast("long").alias("n")))
    return marked.select(key, F.inline(cells))


def term_counts(terms: DataFrame, key: str) -> DataFrame:
    """(term, n, documents); one shuffle of sums by term."""
    return counted_terms(terms, key).groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def document_term_matrix(terms: DataFrame, key: str, min_documents: int = 1) -> DataFrame:
    """Long form (key, term, n) for terms found in enough documents; a term that many documents hold is not gathered anywhere.

    The cells are read several times (counts, hot terms, both sides of the lookup), the texts once.
    """
    cells = settle(counted_terms(terms, key), "cells")
    known = settle(cells.groupBy("term").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= min_documents), "known")
    return lookup(cells, known, ["term"]).where("_d IS NOT NULL").drop("_d")


def topic_models(
    terms: DataFrame, key: str, counts: Sequence[int], top_words: int = 10, min_documents: int = 2, iterations: int = 10, seed: int = 1, held_out: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LDA for several topic counts over all terms that occur in at least ``min_documents`` rows.

    One row in ``held_out`` (by the hash of its key) is kept from the fits. Returns (k,
    log_likelihood, held_out, vocabulary, documents), the second being the log likelihood a
    held-out word; then for the k that predicts them best (topic, term, weight) and (key,
    topic, share). The model holds k numbers for each term of the vocabulary.
    """
    spark = terms.sparkSession
    # small files hold many rows; spread over the cores, as each row is visited in every fit
    terms = settle(terms.repartition(max(spark.sparkContext.defaultParallelism, terms.rdd.getNumPartitions())), "terms")
    size = terms.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count().where(F.col("count") >= min_documents).count()
    if not size:
        raise ValueError(f"no term occurs in {min_documents} rows")
    vectors = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=size, minDF=float(min_documents)).fit(terms)
    counted = settle(vectors.transform(terms).select(key, "features", (F.pmod(F.xxhash64(key), F.lit(held_out)) == 0).alias("apart")), "counts")
    train, documents = counted.where("NOT apart"), counted.count()
    fits = {}
    for k in counts:
        model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(train)
        found = {r["apart"]: r for r in topic_likelihoods(model, counted, "apart").collect()}  # at most three rows
        inner, outer = found.get(False), found.get(True)
        topics = _topics_bound(model)
        words = outer["words"] if outer else 0.0
        fits[k] = (topics + (inner["rows_bound"] if inner else 0.0), (topics + outer["rows_bound"]) / words if words else 0.0, model)
    quality = spark.createDataFrame(
        [(k, a, b, len(vectors.vocabulary), documents) for k, (a, b, _) in fits.items()], "k int, log_likelihood double, held_out double, vocabulary long, documents long"
    )
    best = fits[max(fits, key=lambda k: (fits[k][1], -k))][2]
    top = best.describeTopics(top_words).collect()  # top_words for each topic
    rows = [(r["topic"], vectors.vocabulary[i], float(w)) for r in top for i, w in zip(r["termIndices"], r["termWeights"])]
    shares = best.transform(counted).select(key, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    return quality, spark.createDataFrame(rows, "topic int, term string, weight double"), shares


def topic_likelihoods(model, counted: DataFrame, group: str) -> DataFrame:
    """(group, words, rows_bound): the rows' part of the variational bound that ``model.logLikelihood`` gives.

    That method takes the exponential of the whole topic matrix anew for each row, so its time
    grows with rows times vocabulary. Here a row's topic shares come from ``transform`` and only
    the columns of its own terms are read; the rest of the bound is ``_topics_bound``.
    """
    alpha = np.array(model.estimatedDocConcentration().toArray())
    beta = counted.sparkSession.sparkContext.broadcast(_log_topics(model))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = beta.value
        for batch in batches:
            n_out, out = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            features, shares = batch.column("features"), batch.column("shares").to_pylist()
            indices, values = features.field("indices"), features.field("values")
            for i, share in enumerate(shares):
                n = np.array(values[i].values, dtype=float)
                if not n.any():
                    continue
                gamma = np.array(share) * (alpha.sum() + n.sum())
                theta = digamma(gamma) - digamma(gamma.sum())
                cells = logs[np.array(indices[i].values)] + theta
                peak = cells.max(axis=1)
                n_out[i] = n.sum()
                out[i] = n @ (peak + np.log(np.exp(cells - peak[:, None]).sum(axis=1))) + (alpha - gamma) @ theta
                out[i] += sum(map(math.lgamma, gamma)) - sum(map(math.lgamma, alpha)) + math.lgamma(alpha.sum()) - math.lgamma(gamma.sum())
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(n_out), pa.array(out)], [group, "words", "rows_bound"])

    shared = model.transform(counted).select(group, "features", vector_to_array("topicDistribution").alias("shares"))
    out = T.StructType([counted.schema[group], T.StructField("words", T.DoubleType()), T.StructField("rows_bound", T.DoubleType())])
    return shared.mapInArrow(bounds, out).groupBy(group).agg(F.sum("words").alias("words"), F.sum("rows_bound").alias("rows_bound"))


def _log_topics(model) -> np.ndarray:
    """Expected log weight of each term in each topic, one row a term."""
    weights = model.topicsMatrix().toArray()
    return np.ascontiguousarray(digamma(weights) - digamma(weights.sum(axis=0)))


def _topics_bound(model) -> float:
    """What the topics themselves add to the variational bound."""
    weights = model.topicsMatrix().toArray()
    terms, k = weights.shape
    eta = model.getTopicConcentration() if model.isDefined("topicConcentration") else 1.0 / k
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    bound = ((eta - weights) * _log_topics(model)).sum() + (log_gamma(weights).astype(float) - math.lgamma(eta)).sum()
    return float(bound + k * math.lgamma(eta * terms) - log_gamma(weights.sum(axis=0)).astype(float).sum())


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
