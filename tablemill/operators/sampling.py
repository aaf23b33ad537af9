"""Seeded sampling and splitting.

Random order comes from md5(seed:key), so a row's fate does not depend on partitions,
retries or the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import settle
from tablemill.skew import bucketed, numbered

# hexadecimal digits of the hash used as a number: 15 digits fit a signed long
HASH_DIGITS = 15


def draw(key: Column, seed: int) -> Column:
    """Pseudo-random text that orders rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def draw_number(key: Column, seed: int) -> Column:
    """Pseudo-random non-negative long."""
    return F.conv(F.substring(draw(key, seed), 1, HASH_DIGITS), 16, 10).cast("long")


def downsample(df: DataFrame, response: str, key: str, seed: int = 0) -> DataFrame:
    """All rows of the rarest class and equally many of the others, without replacement."""
    label = F.col(response)
    checked = df.withColumn(
        response, F.when(label.isNull(), F.raise_error(F.lit("labels must not be null")).cast(df.schema[response].dataType)).otherwise(label)
    )
    rarest = checked.groupBy(response).agg(F.count(F.lit(1)).alias("n")).orderBy("n", response).limit(1)
    target = rarest.select(F.struct(F.col(response).alias("label"), "n")).scalar()
    marked = checked.withColumn("_target", target).withColumn("_rare", F.col(response) == F.col("_target.label"))
    others = marked.withColumn("_draw", draw(F.col(key), seed))
    ranked = numbered(others, ["_rare"], ["_draw", key], "_no")
    return ranked.where(F.col("_rare") | (F.col("_no") <= F.col("_target.n"))).select(*df.columns)


def entity_folds(df: DataFrame, entity: str, folds: int, label: Column | None = None, seed: int = 0, name: str = "fold") -> DataFrame:
    """Assign whole entities to folds, stratified by an entity label when one is given."""
    present = F.when(F.col(entity).isNull(), F.raise_error(F.lit("entity must not be null")).cast(df.schema[entity].dataType)).otherwise(F.col(entity))
    grouped = df.withColumn(entity, present).groupBy(entity)
    entities = grouped.agg((F.lit(0) if label is None else label).alias("_label"))
    ranked = numbered(entities.withColumn("_draw", draw(F.col(entity), seed)), ["_label"], ["_draw", entity], "_no")
    return df.join(ranked.select(entity, ((F.col("_no") - 1) % folds).cast("int").alias(name)), entity)


def holdout_mask(df: DataFrame, key: str, n: int, seed: int = 0, name: str = "holdout") -> DataFrame:
    """Mark a fixed number of rows as holdout."""
    ranked = numbered(df.withColumn("_draw", draw(F.col(key), seed)), [], ["_draw", key], "_no")
    return ranked.withColumn(name, F.col("_no") <= n).drop("_draw", "_no")


def stratified_fraction(df: DataFrame, response: str, key: str, fraction: float, strata: int = 10, seed: int = 0) -> DataFrame:
    """The same fraction (rounded down) out of equally filled ranges of the response."""
    tile = lambda no, n: F.floor((no - 1) * strata / n)
    tiled = settle(bucketed(df, [], [response, key], "_tile", tile), "tiles").withColumn("_draw", draw(F.col(key), seed))
    drawn = bucketed(tiled, ["_tile"], ["_draw", key], "_left", lambda no, n: no > F.floor(n * fraction))
    return drawn.where(~F.col("_left")).select(*df.columns)


def bootstrap(df: DataFrame, key: str, samples: int, seed: int = 0, name: str = "sample") -> DataFrame:
    """n-of-n resamples with replacement, tagged with the sample number.

    Positions are drawn and counted per (sample, position) before they meet the rows.
    """
    rows = numbered(df, [], [key], "_no")
    size = df.count()
    draws = df.sparkSession.range(samples * size).select(
        F.floor(F.col("id") / size).cast("int").alias(name), (draw_number(F.col("id"), seed) % size + 1).alias("_no")
    )
    times = draws.groupBy(name, "_no").agg(F.count(F.lit(1)).alias("_times"))
    picked = times.join(rows, "_no").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return picked.select(name, *df.columns)


def sample_tasks(df: DataFrame, task: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` distinct tasks."""
    tasks = df.select(task).distinct().withColumn("_draw", draw(F.col(task), seed))
    return tasks.orderBy("_draw", task).limit(limit).select(task)


def interleaved_folds(df: DataFrame, order: Sequence[str], folds: int, name: str = "fold") -> DataFrame:
    """Fold = row position modulo k."""
    return numbered(df, [], list(order), "_no").withColumn(name, ((F.col("_no") - 1) % folds).cast("int")).drop("_no")


def fold_pairs(df: DataFrame, folds: int, name: str = "fold") -> list[tuple[DataFrame, DataFrame]]:
    """The k (train, validate) pairs of a fold column."""
    return [(df.where(F.col(name) != i), df.where(F.col(name) == i)) for i in range(folds)]
