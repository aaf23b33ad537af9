"""Helpers shared by the operators: settled tables, joins that spread hot keys, components of a graph."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import fresh_folder

#: Words as the contracts define them, for Java's and Python's regular expressions alike.
WORDS = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
#: A key with fewer rows than this is never spread.
HOT_ROWS = 2000
#: Once so few edges are left between what was joined, one task joins the rest; a round costs more than that.
LAST_EDGES = 4096


#: Spark setting: a query removes the files of its own shuffles when it ends, not when its plan is garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files; the caller's setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written to the shared folder during one call; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives a lost executor."""
        path = fresh_folder(self.spark, name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path in self.paths:
                self.paths.remove(path)
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % folds


def spread_join(rows: DataFrame, groups: DataFrame, key: str, count: str, salt: Iterable[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``groups``, which has one row for each ``key`` and the number ``count`` of rows that have it.

    Keys that hold more than ``HOT_SHARE`` of all rows are cut into salts by the columns ``salt`` of the rows,
    and their group row is repeated for each salt. The list of hot keys cannot exceed 1 / HOT_SHARE rows,
    which is why it may be broadcast.
    """
    total, largest = groups.agg(F.sum(count), F.max(count)).first()
    total = total or 0
    limit = max(HOT_ROWS, int(total * HOT_SHARE) + 1)
    hot = groups.filter(F.col(count) > limit).select(F.col(key), F.ceil(F.col(count) / limit).cast("int").alias("__cuts"))
    if not total or largest <= limit:
        return rows.join(groups.drop(count), key, how)
    cuts = F.coalesce("__cuts", F.lit(1))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*salt), cuts).cast("int")).drop("__cuts")
    limit_of = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit).cast("int")).otherwise(1)
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), limit_of - 1))).drop(count)
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def join_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smallest member of the component of every node of a few edges."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for pdf in batches:
        for x, y in zip(pdf["a"], pdf["b"]):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    yield pd.DataFrame({"label": list(up), "next": [root(x) for x in up]})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest member of the connected component of every node that an edge names: ``node``, ``component``.

    Every round each node joins the neighbour (or itself) with the smallest hash, and the edges are drawn
    between what remains; a random order makes the number of rounds logarithmic even on long chains. Edges
    of a hub are spread over tasks. At most ``LAST_EDGES`` remaining edges are joined in one step at the end.
    Nothing is collected but the count of remaining edges.
    """
    scratch = Scratch(edges.sparkSession)
    left = scratch.settle(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links"
    )
    labels = None
    turn = 0
    edges_left = left.count()
    while edges_left:
        if edges_left <= LAST_EDGES:
            kind = left.schema["a"].dataType.simpleString()
            best = left.coalesce(1).mapInPandas(join_all, f"label {kind}, next {kind}").withColumn("n", F.lit(1))
        else:
            order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
            both = left.union(left.select("b", "a"))
            best = both.groupBy(F.col("a").alias("label")).agg(F.min(order("b")).alias("m"), F.count("*").alias("n"))
            best = best.select("label", F.least("m", order("label"))["id"].alias("next"), "n")
        step = scratch.settle(best, "step")
        if labels is None:
            new_labels = scratch.settle(step.select(F.col("label").alias("node"), F.col("next").alias("label")), "labels")
        else:
            sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
            moves = step.select("label", "next").join(sizes, "label")
            moved = spread_join(labels, moves, "label", "n", ["node"], "left")
            new_labels = scratch.settle(moved.select("node", F.coalesce("next", "label").alias("label")), "labels")
            scratch.drop(labels)
        labels = new_labels
        if edges_left <= LAST_EDGES:
            scratch.drop(step)
            break
        ends = spread_join(left.withColumnRenamed("a", "label"), step, "label", "n", ["b"]).select(F.col("next").alias("x"), F.col("b").alias("label"))
        ends = spread_join(ends, step, "label", "n", ["x"]).select("x", F.col("next").alias("y"))
        rest = ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = scratch.settle(rest, "links")
        scratch.drop(left, step)
        left, edges_left = after, after.count()
        turn += 1
    scratch.drop(left)
    if labels is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return spread_join(labels, scratch.settle(smallest, "smallest"), "label", "n", ["node"]).select("node", "component")
