"""Registration, table access and the rounding both engines share."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``R6(x)`` and ``R3(x)`` in the SQL expand to the rounding of :func:`r6` and :func:`r3`."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals. The cut lies at .51 rather than .5, so that exact decimal ties do not
    depend on the order in which an engine adds."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value.cast("double") * 1e6 + 0.49) / 1e6


def r3(c: Column | str) -> Column:
    """Three decimals in the same way, for values far above 1 that many additions went into."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value.cast("double") * 1e3 + 0.49) / 1e3


def expand(sql: str) -> str:
    while (m := re.search(r"\bR([36])\(", sql)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        body = sql[m.end() : i - 1]
        sql = f"{sql[: m.start()]}(floor(CAST(({body}) AS DOUBLE) * 1e{m[1]} + 0.49) / 1e{m[1]}){sql[i:]}"
    return sql


def day_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
