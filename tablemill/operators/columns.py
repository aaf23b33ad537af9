"""Column transforms that need the whole table or several columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import numbers, times
from tablemill.operators.filters import Report
from tablemill.session import settle
from tablemill.skew import attach, order_columns

# Words that mean "too many to count", their stand-in, and the sign rules.
TOO_NUMEROUS = ("too numerous to count ", "tntc", "dnpc", "tnct", '"dnpc"', "ntc", "tmtc", "ttc", "tnt")
TOO_NUMEROUS_VALUE = 5000.0
COORDINATE_SIGNS = {
    "Peru": (-1, -1),
    "Haiti": (1, -1),
    "Indonesia": (0, 1),
    "Mexico": (0, -1),
    "Honduras": (0, -1),
    "Liberia": (1, 0),
    "Malawi": (-1, 1),
    "Tanzania": (0, 1),
    "Uganda": (0, 1),
    "Kenya": (0, 1),
}


def coerce_id(df: DataFrame, column: str) -> DataFrame:
    """Cast a key to long and drop rows without one."""
    return df.withColumn(column, numbers.coerce_long(F.col(column).cast("string"))).where(F.col(column).isNotNull())


def one_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The single value of each group; a group of another size is an error."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    checked = F.when(F.col("_n") == 1, F.col(value)).otherwise(
        F.raise_error(F.lit(f"more than one row per group of {list(keys)}")).cast(df.schema[value].dataType)
    )
    return got.select(*keys, checked.alias(value))


def week_calendar(df: DataFrame, year: str, day: str, weekday: int = 2, skipped: Mapping[int, int] | None = None) -> DataFrame:
    """Distinct (year, day) with the week number inside the year.

    Weeks open on ``weekday``; 1 is the week of the year's first row. ``skipped`` maps a
    year to the week number after which one calendar week had no play.
    """
    days = df.select(year, day).distinct().withColumn("week", times.week_floor(F.col(day), weekday))
    first = days.groupBy(year).agg(F.min("week").alias("_first"))
    number = 1 + F.floor(F.datediff("week", "_first") / 7)
    for y, last in (skipped or {}).items():
        number = F.when((F.col(year) == y) & (number > last), number - 1).otherwise(number)
    return days.join(first, year).withColumn("week_number", number.cast("long")).drop("_first")


def convert_parameter_units(df: DataFrame, parameter: str = "parameter", unit: str = "unit", value: str = "value") -> DataFrame:
    """One unit per parameter: mg/L, Celsius or CFU/100ml; the input unit stays in ``original_unit``.

    Concentrations and temperatures are converted. Counts map the words for "too many"
    to 5000, lose unparsable rows and are capped at 5000. Any other mix of units is an error.
    """
    name, text = F.col(unit), F.col(value).cast("string")
    chlorine = (F.lower(parameter) == "chlorine, free") & name.isin("mg/L", "CFU/100ml")
    df = df.withColumn("original_unit", name).withColumn(unit, F.when(chlorine, "mg/L").otherwise(name))

    def used(u: str) -> Column:
        return F.max((F.col(unit) == u).cast("int")) == 1

    def allowed(*units: str) -> Column:
        return F.min(F.col(unit).isin(*units).cast("int")) == 1

    family = (
        F.when(used("mg/L") | used("ppb"), F.when(allowed("mg/L", "ppb"), "concentration"))
        .when(used("Celsius") | used("Fahrenheit"), F.when(allowed("Celsius", "Fahrenheit"), "temperature"))
        .when(used("CFU/100ml"), F.when(allowed("CFU/100ml"), "count"))
        .otherwise(F.when(F.min(unit) == F.max(unit), "other"))
    )
    # one row for each parameter; written down, it is known to be small, so the rows need not meet in a task for each parameter
    families = settle(df.groupBy(parameter).agg(F.coalesce(family, F.lit("mixed")).alias("_family")), "families")
    joined = df.join(families, parameter)
    kind, number = F.col("_family"), numbers.coerce_numeric(text)
    beyond = F.lower(text).isin(*TOO_NUMEROUS) | (number > TOO_NUMEROUS_VALUE)
    counted = F.when(beyond, TOO_NUMEROUS_VALUE).otherwise(number)
    converted = (
        F.when(kind == "mixed", F.raise_error(F.concat(F.lit("several units for "), F.col(parameter))).cast("double"))
        .when(kind == "concentration", F.when(name == "ppb", number / 1000.0).otherwise(number))
        .when(kind == "temperature", F.when(name == "Fahrenheit", (number - 32.0) * (5 / 9.0)).otherwise(number))
        .when(kind == "count", counted)
        .otherwise(number)
    )
    target = F.when(kind == "concentration", "mg/L").when(kind == "temperature", "Celsius").otherwise(name)
    out = joined.withColumn(value, converted).withColumn(unit, target)
    return out.where((F.col("_family") != "count") | F.col(value).isNotNull()).drop("_family")


def fix_coordinate_signs(
    df: DataFrame, country: str, lat: str, lon: str, signs: Mapping[str, tuple[int, int]] = COORDINATE_SIGNS
) -> DataFrame:
    """Force the sign of coordinates by country (0 leaves it), flag changes, drop missing ones."""
    rows = df.dropDuplicates()
    fixed = {lat: F.col(lat), lon: F.col(lon)}
    for place, pair in signs.items():
        for column, sign in zip((lat, lon), pair):
            if sign:
                fixed[column] = F.when(F.col(country) == place, sign * F.abs(F.col(column))).otherwise(fixed[column])
    out = rows.withColumns({"corrected_lat": fixed[lat], "corrected_lon": fixed[lon]})
    changed = (F.col(lat) != F.col("corrected_lat")) | (F.col(lon) != F.col("corrected_lon"))
    return out.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("is_error", changed)


def outcome_bins(df: DataFrame, prefix: str) -> DataFrame:
    """Three binary readings of every ``<prefix>-<k>`` ordinal column."""
    chosen = [c for c in df.columns if c.startswith(prefix) and len(c.split("-")) == 2]
    rules = {"favalive": numbers.favourable_among_alive, "favorable": numbers.favourable, "alive": numbers.alive}
    return df.withColumns({f"{c}-{s}": rule(F.col(f"`{c}`")) for c in chosen for s, rule in rules.items()})


def log_columns(df: DataFrame, columns: Sequence[str], kind: str = "log10") -> DataFrame:
    """Transform columns and rename them ``<name>_Log``."""
    rule = {"log10": numbers.log10_value, "asinh": numbers.asinh_value}[kind]
    return df.withColumns({c: rule(F.col(f"`{c}`")) for c in columns}).withColumnsRenamed({c: f"{c}_Log" for c in columns})


def floor_negative_infinity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace -Infinity by min - 0.1 * (max - min) of the finite values of the column."""
    bounds = {}
    for c in columns:
        value = numbers.finite(F.col(c))
        bounds |= {f"_lo_{c}": F.min(value), f"_hi_{c}": F.max(value)}
    out = attach(df, [], bounds)
    fixed = {}
    for c in columns:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        fixed[c] = (
            F.when(F.col(c) == math.inf, F.raise_error(F.lit(f"positive infinity in {c}")).cast("double"))
            .when(low.isNull(), F.lit(None).cast("double"))
            .when(F.col(c) == -math.inf, low - 0.1 * (high - low))
            .otherwise(F.col(c))
        )
    return out.withColumns(fixed).drop(*bounds)


def add_calculated_sums(df: DataFrame) -> DataFrame:
    """Totals by column family; families that are missing are skipped."""
    names = df.columns
    new: dict[str, Column] = {}
    expenses, income = numbers.sum_with_prefix(names, "Expenses"), numbers.sum_with_prefix(names, "Income")
    if expenses is not None:
        new["ExpensesAll"] = expenses
    if income is not None:
        new["IncomeAll"] = income
        if expenses is not None:
            new["IncomeNet"] = income - expenses
    if any(c.startswith("Cash") for c in names):
        begin = numbers.row_sum(["CashInBankBeginning", "CashOnHandBeginning"])
        end = numbers.row_sum(["CashInBankEnd", "CashOnHandEnd"])
        new |= {"CashBeginning": begin, "CashEnd": end, "CashNet": end - begin}
    volume = numbers.sum_with_prefix(names, "QuantityWater")
    if volume is not None:
        new["QuantityWaterAll"] = volume
    return df.withColumns(new) if new else df


def divide_family(df: DataFrame, columns: Sequence[str], rate: str) -> DataFrame:
    """Convert money columns by the exchange rate in the row."""
    return df.withColumns({c: F.try_divide(F.col(c), F.col(rate)) for c in columns})


def add_binary_fields(df: DataFrame, fields: Sequence[Mapping[str, str]]) -> DataFrame:
    """Configured ``diff`` and ``log_ratio`` columns.

    Log ratios that are not finite take the smallest finite ratio of the table.
    """
    out = df
    ratios = []
    for f in fields:
        left, right = F.col(f"`{f['left']}`").cast("double"), F.col(f"`{f['right']}`").cast("double")
        if f["op"] == "diff":
            out = out.withColumn(f["result"], left - right)
        elif f["op"] == "log_ratio":
            ratio = F.try_divide(left, right)
            out = out.withColumn(f["result"], numbers.finite(F.when(ratio > 0, F.log(ratio))))
            ratios.append(f["result"])
        else:
            raise ValueError(f"operation not supported: {f['op']}")
    if ratios:
        out = attach(out, [], {f"_min_{r}": F.min(r) for r in ratios})
        out = out.withColumns({r: F.coalesce(r, f"_min_{r}") for r in ratios}).drop(*[f"_min_{r}" for r in ratios])
    return out


def conditional_transform(
    df: DataFrame, field: str, mask: Column, value: Column, target: str | None = None
) -> tuple[DataFrame, Report]:
    """Replace a value where the mask holds; the report holds changed and total rows."""
    hit = F.coalesce(mask, F.lit(False))
    counts = df.agg(F.count(F.when(hit, 1)).alias("changed"), F.count(F.lit(1)).alias("total"))
    return df.withColumn(target or field, F.when(hit, value).otherwise(F.col(field))), Report(counts)


def weighted_priority(df: DataFrame, weights: Mapping[str, float], score: str = "priority") -> DataFrame:
    """Weighted sum of min-max scaled criteria; weights are scaled to sum 1."""
    total = sum(weights.values())
    bounds = {f"_lo_{c}": F.min(c) for c in weights} | {f"_hi_{c}": F.max(c) for c in weights}
    out = attach(df, [], bounds)
    value = F.lit(0.0)
    for c, w in weights.items():
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        value = value + (w / total) * F.try_divide(F.col(c) - low, (high - low).cast("double"))
    return out.withColumn(score, value).drop(*bounds)


def top_by(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows of the table in the given order."""
    return df.orderBy(*order_columns(order)).limit(n)


def mean_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the column mean; the mean stays in ``<name>_mean``. Negative input is an error."""
    out = attach(df, [], {f"{c}_mean": F.avg(c) for c in columns})
    scaled = {
        c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"negative value in {c}")).cast("double")).otherwise(
            F.try_divide(F.col(c), F.col(f"{c}_mean"))
        )
        for c in columns
    }
    return out.withColumns(scaled)


def mean_unscale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of :func:`mean_scale`."""
    return df.withColumns({c: F.col(c) * F.col(f"{c}_mean") for c in columns}).drop(*[f"{c}_mean" for c in columns])
