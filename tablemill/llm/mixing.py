"""Mixing sources to target weights by Sainte-Laguë apportionment: blocks of tokens to sources, tokens to shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import WORDS, Scratch


def apportion(table: DataFrame, group: Sequence[str], key: str, weight: str, seats: str) -> DataFrame:
    """Give ``seats`` integer seats of every group to its rows by the highest quotients weight / (2 k - 1).

    Seats that every divisor near the final one gives are given at once; only the last few (about one for
    each row) are ranked by quotient, ties by key. Rows of weight 0 get none. Adds ``quota``.
    """
    whole = Window.partitionBy(*group)
    own = F.col(weight) > 0
    t = table.withColumn("__sum", F.sum(weight).over(whole)).withColumn("__n", F.sum(own.cast("int")).over(whole))
    share = F.when(own, F.col(weight) / F.col("__sum")).otherwise(0.0)
    sure = F.greatest(F.floor(share * F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0.0)) + 0.5) - 1, F.lit(0))
    most = F.when(own & (F.col(seats) > 0), F.floor(share * (F.col(seats) + F.col("__n") / 2) + 0.5) + 1).otherwise(0)
    t = t.withColumn("__sure", sure.cast("long")).withColumn("__most", F.greatest(most.cast("long"), "__sure"))
    t = t.withColumn("__open", (F.col(seats) - F.sum("__sure").over(whole)).cast("long"))
    claims = t.filter("__most > __sure").select(
        *group, key, "__open", F.col(weight).alias("__w"), F.explode(F.sequence(F.col("__sure") + 1, F.col("__most"))).alias("__k")
    )
    ranked = claims.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("__w") / (2 * F.col("__k") - 1)).desc(), key, "__k"))
    )
    won = ranked.filter("__rank <= __open").groupBy(*group, key).agg(F.count("*").alias("__won"))
    joined = t.join(won, [*group, key], "left")
    return joined.withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__sum", "__n", "__sure", "__most", "__open", "__won")


def source_targets(totals: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets of the sources: all tokens shared by weight, at most ``cap`` times a source's tokens.

    ``totals`` has source, __key, source_size. Sorted by the level at which each source fills up, the sources
    that fill are a prefix, so one pass over running sums finds the level of the others.
    """
    all_rows = Window.partitionBy(F.lit(0))
    before = all_rows.orderBy("__full", "__key").rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("weight", F.element_at(table, ((number - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("__full", cap * F.col("source_size") / F.col("weight"))
    t = t.withColumn("__spent", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)))
    t = t.withColumn("__light", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("__level", (F.sum("source_size").over(all_rows) - F.col("__spent")) / F.col("__light"))
    level = F.min(F.when(F.col("__level") < F.col("__full"), F.struct("__full", "__key", "__level"))).over(all_rows)["__level"]
    t = t.withColumn("target", F.least(F.coalesce(level, F.lit(0.0)) * F.col("weight"), cap * F.col("source_size")).cast("double"))
    return t.select("source", "__key", "source_size", "target")


def mix(
    docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", *, weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0, block_tokens: int = 16, rows_per_shard: int = 8192, seed: int = 7,
) -> DataFrame:
    """Decide how many tokens of every document the mix takes.

    Documents are dealt to shards of their source, one for each ``rows_per_shard`` of its documents with tokens, by
    a seeded hash of ``key`` and put into a seeded order within each (source, shard), where their tokens lie end to
    end. Blocks of ``block_tokens`` tokens are apportioned to sources by target, then the tokens of each source's
    blocks to its shards by tokens, both by highest quotients. A quota above a shard's tokens means whole passes; the
    rest is a run of consecutive tokens (round the end) from a seeded start, so that all but two documents of a
    cell stay whole.

    Returns the columns of ``docs`` and source_size, target, taken (tokens), passes (whole repeats), ranges
    (token intervals taken once more); columns of those names in ``docs`` are replaced.
    Null or zero sizes take nothing; a null source is a source of its own, last in order; repeated rows
    are rows like others (equal keys are neighbours in order, so any order of them gives the same rows);
    an empty table gives an empty result. Windows cover one (source, shard), about ``rows_per_shard`` rows
    at most, whatever a source's share; the table of sources is the only one sorted as a whole.
    """
    names = ["source_size", "target", "taken", "passes", "ranges"]
    scratch = Scratch(docs.sparkSession)
    shards = max(1, math.ceil(docs.count() / rows_per_shard))
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c not in names]).alias("__row"), F.col(source).alias("__source"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("__key"),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("__h"),
    ).withColumn("__fine", F.pmod(F.shiftright("__h", 3), F.lit(shards))).withColumn("__full", F.col("__size") > 0)
    tallies = scratch.settle(
        rows.groupBy("__source", "__key", "__fine", "__full").agg(F.sum("__size").alias("tokens"), F.count("*").alias("n")), "cells"
    )
    # sources of more than one shard: at most one for each rows_per_shard documents
    large = tallies.filter("__full").groupBy("__key").agg(F.ceil(F.sum("n") / rows_per_shard).alias("__cells")).filter("__cells > 1")

    def dealt(table: DataFrame) -> DataFrame:
        """A source's shard takes the documents of neighbouring ones of all rows; those without tokens stay apart."""
        own = F.floor(F.col("__fine") * F.coalesce("__cells", F.lit(1)) / shards)
        return table.join(F.broadcast(large), "__key", "left").withColumn("__shard", F.when(F.col("__full"), own).otherwise(-1 - F.col("__fine"))).drop("__cells")

    cells = dealt(tallies).groupBy("__source", "__key", "__shard").agg(F.sum("tokens").alias("tokens"))
    totals = cells.groupBy(F.col("__source").alias("source"), "__key").agg(F.sum("tokens").alias("source_size"))
    targets = source_targets(totals, weights, cap)
    targets = targets.withColumn("__all", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("__all")) / block_tokens))
    quotas = scratch.settle(apportion(targets, ["__all"], "__key", "target", "seats"), "quotas")
    parts = cells.select("__key", "__shard", "tokens").join(
        quotas.select("__key", "source_size", "target", F.least(F.col("quota") * block_tokens, F.floor(cap * F.col("source_size"))).cast("double").alias("seats")), "__key"
    )
    plan = apportion(parts, ["__key"], "__shard", "tokens", "seats")
    plan = plan.withColumn("__of", F.greatest("tokens", F.lit(1)))
    plan = plan.withColumn("passes", F.floor(F.col("quota") / F.col("__of")).cast("int")).withColumn("__run", F.col("quota") % F.col("__of"))
    plan = plan.withColumn("__a", F.pmod(F.xxhash64(F.lit(seed + 1), "__key", "__shard"), F.col("__of")))
    end = F.col("__a") + F.col("__run")
    plan = plan.select(
        "__key", "__shard", "source_size", "target", "passes", "__a", F.least(end, "__of").alias("__b"), F.greatest(end - F.col("__of"), F.lit(0)).alias("__c"),
    )
    plan = scratch.settle(plan, "plan")
    order = Window.partitionBy("__key", "__shard").orderBy("__h", "__size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(rows).withColumn("__end", F.sum("__size").over(order)).withColumn("__begin", F.col("__end") - F.col("__size"))
    placed = placed.join(plan, ["__key", "__shard"])
    first = F.struct(F.greatest("__begin", F.lit(0)).alias("start"), F.least("__end", "__c").alias("end"))
    second = F.struct(F.greatest("__begin", "__a").alias("start"), F.least("__end", "__b").alias("end"))
    inside = F.filter(F.array(first, second), lambda r: r["end"] > r["start"])
    local = F.transform(inside, lambda r: F.struct((r["start"] - F.col("__begin")).alias("start"), (r["end"] - F.col("__begin")).alias("end")))
    out = placed.withColumn("ranges", local)
    once = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return out.select("__row.*", "source_size", "target", (F.col("passes") * F.col("__size") + once).cast("long").alias("taken"), "passes", "ranges")


def emit(mixed: DataFrame, row: str, text: str = "text", chars: str = "n_chars", size: str = "size") -> DataFrame:
    """The documents of a mix: one row for each whole pass and one for each extra token range.

    ``row`` is the struct of a document's columns. A range that covers the whole document repeats it; a part
    keeps the words inside, one space between, with ``chars`` counted anew where that field exists. Documents
    without words (null texts too) take no share of a mix and are kept once.
    """
    fields = mixed.schema[row].dataType.names
    span = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    passes = F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(F.array().cast("array<int>"))
    whole = F.transform(passes, lambda _: span(F.lit(0), F.col(size)))
    pieces = F.when(F.col(size) == 0, F.array(span(F.lit(0), F.lit(0)))).otherwise(F.concat(whole, "ranges"))
    rows = mixed.withColumn("__piece", F.explode(pieces))
    start, end = F.col("__piece.start"), F.col("__piece.end")
    old = F.col(row)[text]
    part = (start > 0) | (end < F.col(size))
    words = F.regexp_extract_all(old, F.lit(f"({WORDS})"), F.lit(1))
    rows = rows.withColumn("__text", F.when(part, F.concat_ws(" ", F.slice(words, (start + 1).cast("int"), (end - start).cast("int")))).otherwise(old))
    values = {text: F.col("__text"), chars: F.when(part, F.length("__text").cast("long")).otherwise(F.col(row)[chars]) if chars in fields else None}
    return rows.select(*[(F.col(row)[c] if values.get(c) is None else values[c]).alias(c) for c in fields])
