"""Validation: reports of violations, and guards that stop a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.skew import top_rows

# Text forms accepted per type name.
TYPE_PATTERNS = {
    "int": r"^\s*[-+]?\d+\s*$",
    "float": r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$",
    "bool": r"^(?i)(true|false)$",
}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of every key held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """The table itself, or an error that shows some of the repeated keys."""
    found = duplicate_keys(df, keys).limit(examples).collect()
    if found:
        raise ValueError(f"key {list(keys)} is not unique, for example {[tuple(r) for r in found]}")
    return df


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lazy guard: one row per key, an error while running when a key repeats."""
    others = [c for c in df.columns if c not in keys]
    body = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(1).alias("_one"))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(body).alias("_row"))
    message = F.concat(F.lit(f"key {list(keys)} repeats: "), F.to_json(F.struct(*keys)))
    checked = grouped.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message).cast(body_type(df, others))))
    return checked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def body_type(df: DataFrame, columns: Sequence[str]):
    from pyspark.sql import types as T

    fields = [T.StructField(c, df.schema[c].dataType) for c in columns]
    return T.StructType(fields or [T.StructField("_one", T.IntegerType())])


def violations(df: DataFrame, not_null: Sequence[str] = (), ranges: Mapping[str, tuple] | None = None) -> DataFrame:
    """(rule, violations): nulls in named columns, values outside a range (null allowed)."""
    counts: dict[str, Column] = {f"{c} is null": F.count(F.when(F.col(c).isNull(), 1)) for c in not_null}
    for c, (low, high) in (ranges or {}).items():
        counts[f"{c} outside [{low}, {high}]"] = F.count(F.when(~F.col(c).between(low, high), 1))
    wide = df.agg(*[v.alias(f"_{i}") for i, v in enumerate(counts.values())])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("violations")) for i, r in enumerate(counts)])
    return wide.select(F.inline(rules))


def type_offenders(df: DataFrame, column: str, allowed: Sequence[str], examples: int = 10) -> DataFrame:
    """Up to ten distinct non-null texts that parse as none of the allowed types."""
    if "str" in allowed and set(allowed) == {"str"}:
        parses = ~(F.col(column).rlike(TYPE_PATTERNS["float"]) | F.col(column).rlike(TYPE_PATTERNS["bool"]))
    else:
        parses = F.lit("str" in allowed)
        for t in allowed:
            if t != "str":
                parses = parses | F.col(column).rlike(TYPE_PATTERNS[t])
    return top_rows(df.where(F.col(column).isNotNull() & ~parses).select(column).distinct(), [], [column], examples)


def column_disagreements(tables: Mapping[str, DataFrame], keys: Sequence[str], column: str) -> DataFrame:
    """Keys for which a column differs between tables (null equals null, absent rows are ignored)."""
    parts = None
    for name, df in tables.items():
        part = df.select(*keys, F.lit(name).alias("source"), F.col(column).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    low, high = F.min("value"), F.max("value")
    nulls = F.count(F.when(F.col("value").isNull(), 1))
    got = parts.groupBy(*keys).agg(low.alias("low"), high.alias("high"), nulls.alias("nulls"), F.count(F.lit(1)).alias("n"))
    return got.where((F.col("low") != F.col("high")) | ((F.col("nulls") > 0) & (F.col("nulls") < F.col("n"))))


def groups_with_many_values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column does not have exactly one distinct value."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("values")).where("values <> 1")


def missing_references(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Distinct keys of one table that another table lacks."""
    right = other.select(F.col(other_key).alias(key))
    return df.select(key).where(F.col(key).isNotNull()).join(right, key, "left_anti").distinct()


def require_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """The second table, or an error when a join changed the number of rows."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"expected {a} rows, found {b}")
    return after


def incomplete_sequences(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Groups whose distinct numbers are not exactly 1..n."""
    got = df.groupBy(*keys).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.countDistinct(number).alias("n"))
    return got.where((F.col("low") != 1) | (F.col("high") != F.col("n")))
