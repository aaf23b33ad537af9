"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import Scratch

#: numpy draws hypergeometric numbers for populations below this size.
NUMPY_POPULATION = 10**9


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number for populations of any size, by inversion around the mode when large."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(12 * math.sqrt(n * (good / total) * (bad / total) * max(total - n, 1) / total)) + 20
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))


def deal(sizes: list[int], room: list[int], seed: list[int]) -> list[list[int]]:
    """Rows of the matrix: how many of each part's rows go to each shard, filling ``room`` exactly."""
    left, out = list(room), []
    for i, n in enumerate(sizes):
        rng = np.random.default_rng([*seed, i])
        counts, rest, others = [], n, sum(left)
        for r in left:
            others -= r
            c = draw(rng, r, others, rest)
            counts.append(c)
            rest -= c
        left = [r - c for r, c in zip(left, counts)]
        out.append(counts)
    return out


def shuffle_shards(docs: DataFrame, id_columns: list[str], shards: int = 8, rows_per_block: int = 8192, seed: int = 11) -> DataFrame:
    """Put every row into a shard at a random place; shard sizes differ by one row at most.

    Rows form blocks by a seeded hash of ``id_columns`` (so a lost task finds the same block again). The
    matrix of counts from block to shard is drawn exactly: first for groups of blocks, then inside each
    group, so that no task draws more than about the square root of the number of blocks. Within a block a
    seeded order decides which rows go where; within a shard another seeded order, cut into pieces of about
    ``rows_per_block`` rows, gives the places.

    Returns the columns of ``docs`` and shard int (0 ..), slot long (0 .. in each shard); columns of those
    names are replaced. Nulls hash like values. Rows equal in ``id_columns`` are numbered and
    placed independently; which of them is which does not matter. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    total = docs.count()
    blocks = max(1, math.ceil(total / rows_per_block))
    side = math.isqrt(blocks - 1) + 1
    pieces = max(1, math.ceil(total / shards / rows_per_block))
    room = [total // shards + (i < total % shards) for i in range(shards)]
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("__row"), F.xxhash64(F.lit(seed), *id_columns).alias("__h"))
    rows = rows.withColumn("__block", F.pmod("__h", F.lit(blocks)).cast("long"))
    sizes = scratch.settle(rows.groupBy("__block").agg(F.count("*").alias("n")).withColumn("__group", F.floor(F.col("__block") / side)), "blocks")

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__group")
        return pd.DataFrame({"__group": pdf["__group"], "room": deal(pdf["n"].astype(int).tolist(), room, [seed, 1])})

    def lower(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        counts = deal(pdf["n"].astype(int).tolist(), [int(x) for x in pdf["room"].iloc[0]], [seed, 2, int(key[0])])
        return pd.DataFrame({"__block": pdf["__block"], "ends": [np.cumsum(c).tolist() for c in counts]})

    groups = sizes.groupBy("__group").agg(F.sum("n").alias("n")).withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(upper, "__group long, room array<long>")
    matrix = sizes.join(groups, "__group").groupBy("__group").applyInPandas(lower, "__block long, ends array<long>")
    matrix = scratch.settle(matrix, "matrix")

    def assigned(frame: DataFrame) -> DataFrame:
        inside = Window.partitionBy("__block")
        # equal rows get numbers of their own, so that each is placed by itself
        out = frame.withColumn("__n", F.row_number().over(inside.orderBy("__h")))
        out = out.withColumn("__place", F.row_number().over(inside.orderBy(F.xxhash64(F.lit(seed + 1), "__block", "__n"), "__n"))).join(matrix, "__block")
        out = out.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("__place"))))
        out = out.withColumn("__g", F.xxhash64(F.lit(seed + 2), "__block", "__n"))
        return out.withColumn("__piece", F.pmod(F.shiftright("__g", 5), F.lit(pieces))).drop("ends", "__place", "__n")

    counts = assigned(rows.drop("__row")).groupBy("shard", "__piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__piece")) - F.col("n")
    offsets = scratch.settle(counts.select("shard", "__piece", before.alias("__before")), "offsets")
    inner = F.row_number().over(Window.partitionBy("shard", "__piece").orderBy("__g", "__h")) - 1
    out = assigned(rows).withColumn("__at", inner).join(offsets, ["shard", "__piece"])
    return out.select("__row.*", F.col("shard").cast("int"), (F.col("__before") + F.col("__at")).cast("long").alias("slot"))
