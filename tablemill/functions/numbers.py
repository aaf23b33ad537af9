"""Numeric expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
ANY_NUMBER = r"([-+]?\d*\.\d+|\d+)"

# Litres per unit.
LITRES_PER_UNIT = {"gallons": 3.78541, "liters": 1.0, "cubic meters": 1000.0}


def coerce_numeric(c: Column) -> Column:
    """String to double; anything that is not a plain number becomes null."""
    return F.when(c.rlike(PLAIN_NUMBER), F.trim(c).try_cast("double"))


def coerce_long(c: Column) -> Column:
    return coerce_numeric(c).try_cast("long")


def first_number(c: Column) -> Column:
    """First number in a text. A sign counts only in front of a decimal fraction."""
    return F.nullif(F.regexp_extract(c.cast("string"), ANY_NUMBER, 1), F.lit("")).try_cast("double")


def stat_number(metric: Column, value: Column) -> Column:
    """Box-score notations: ``30t`` -> 30, ``5/7`` -> 5, ``--`` -> 0, list metric -> list length."""
    parts = F.split(value, "/")
    return (
        F.when(metric == "kicking:Miss", F.size(F.split(value, ",")).cast("double"))
        .when(value.endswith("t"), F.replace(value, F.lit("t"), F.lit("")).try_cast("double"))
        .when(F.size(parts) == 2, parts[0].try_cast("double"))
        .when(value == "--", F.lit(0.0))
        .otherwise(value.try_cast("double"))
    )


def to_litres(value: Column, unit: Column) -> Column:
    """Volumes in litres; unknown or missing units give null, other units are an error."""
    number, name = coerce_numeric(value.cast("string")), F.lower(F.trim(unit))
    out = F.when(number.isNull() | name.isNull() | (name == "unknown"), F.lit(None).cast("double"))
    for known, litres in LITRES_PER_UNIT.items():
        out = out.when(name == known, number * litres)
    message = F.concat(F.lit("unit not supported: "), name)
    return out.otherwise(F.raise_error(message).cast("double"))


def asinh_value(c: Column) -> Column:
    return F.asinh(c)


def log10_value(c: Column) -> Column:
    """Base-10 logarithm that keeps -Infinity at zero."""
    return F.when(c == 0, F.lit(-math.inf)).otherwise(F.log10(c))


def finite(c: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def sum_with_prefix(columns: Sequence[str], prefix: str) -> Column | None:
    """Row sum over the columns with a prefix, nulls as 0; None when the family is missing."""
    return row_sum([c for c in columns if c.startswith(prefix)])


def row_sum(columns: Sequence[str]) -> Column | None:
    total = None
    for c in columns:
        term = F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
        total = term if total is None else total + term
    return total


def safe_fraction(part: Column, whole: Column) -> Column:
    """part / whole, 0 when it cannot be computed."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def sigmoid(c: Column, clip: float | None = None) -> Column:
    """Logistic function that never overflows; input optionally clipped to +/-clip."""
    x = c if clip is None else F.when(c > clip, clip).when(c < -clip, -clip).otherwise(c)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def favourable_among_alive(c: Column) -> Column:
    return F.when(c.isin(2, 3), 0).when(c.isin(4, 5), 1)


def favourable(c: Column) -> Column:
    return F.when(c.isin(1, 2, 3), 0).when(c.isin(4, 5), 1)


def alive(c: Column) -> Column:
    return F.when(c.isNotNull(), (c > 1).cast("int"))


def binned(c: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Index of the bin between consecutive edges; null outside.

    closed='left': [a, b); closed='right': (a, b] with the first edge included.
    """
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low, high = edges[i], edges[i + 1]
        if closed == "left":
            inside = (c >= low) & (c < high)
        else:
            inside = ((c >= low) if i == 0 else (c > low)) & (c <= high)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def digest(c: Column, kind: str) -> Column:
    """md5, sha1 or sha256 as hex; null stays null."""
    makers = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}
    return makers[kind](c.cast("binary"))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Replace values found in a small fixed table, keep the others."""
    out = c
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out
