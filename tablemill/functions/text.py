"""Text expressions and column naming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reaction words, canonical spelling by sorted letters, ordinals.
REACTIONS = ("brisk", "brsik", "birsk", "fixed", "nonreactive", "sluggish", "uta")
SPELLING_BY_LETTERS = {"bikrs": "brisk"}
REACTION_LEVELS = {"nonreactive": 1, "fixed": 2, "sluggish": 3, "brisk": 4}


def fill_category(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(c, F.lit(default))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def side_value(c: Column, side: str, pattern: str) -> Column:
    """Value noted for one side in texts such as ``Left - 3mm, Right - 2mm``."""
    return F.nullif(F.regexp_extract(F.lower(c), f"{side} - {pattern}", 1), F.lit(""))


def canonical_reaction(c: Column, words: Sequence[str] = REACTIONS) -> Column:
    """First known word in the text; misspellings are repaired by their letters."""
    found = F.nullif(F.regexp_extract(F.lower(c), f"({'|'.join(words)})", 1), F.lit(""))
    letters = F.array_join(F.array_sort(F.split(found, "")), "")
    out = found
    for key, word in SPELLING_BY_LETTERS.items():
        out = F.when(letters == key, F.lit(word)).otherwise(out)
    return out


def reaction_level(word: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, level in REACTION_LEVELS.items():
        out = F.when(word == name, F.lit(level)).otherwise(out)
    return out


def tidy_name(name: str, aliases: Mapping[str, str] | None = None) -> str:
    """Trim, lower, blanks to ``_``, commas dropped, then the alias table."""
    plain = name.strip().lower().replace(" ", "_").replace(",", "")
    return (aliases or {}).get(plain, plain)


def tidy_names(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: tidy_name(c, aliases) for c in df.columns})


def affix_names(df: DataFrame, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in keep})


def title_text(c: Column) -> Column:
    """Trimmed, with a capital after every non-letter."""
    pieces = F.split(F.lower(F.trim(c)), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def ascii_only(c: Column) -> Column:
    """Every character outside ASCII becomes a blank."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def word_characters(c: Column) -> Column:
    """Only letters, digits, ``_`` and ``-`` remain."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "")


def last_token(c: Column, delimiter: str = " ") -> Column:
    return F.element_at(F.split(c, re.escape(delimiter)), -1)


def all_but_last_token(c: Column, delimiter: str = " ") -> Column:
    parts = F.split(c, re.escape(delimiter))
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), delimiter)


def token(c: Column, delimiter: str, number: int) -> Column:
    """1-based token, null when there are fewer."""
    return F.get(F.split(c, re.escape(delimiter)), number - 1)


def place_in_brackets(c: Column) -> tuple[Column, Column]:
    """``Stadium (City, ST)`` -> (stadium, place)."""
    pattern = r"^(.*?)\s*\((.*)\)\s*$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def point_label(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    return F.format_string("%s:%s (%s | %s)", a.cast("string"), b.cast("string"), name_a, name_b)


def select_matching(
    df: DataFrame,
    pattern: str | None = None,
    prefixes: Sequence[str] = (),
    names: Sequence[str] = (),
    drop: bool = False,
    expected: int | None = None,
) -> DataFrame:
    """Keep (or drop) columns chosen by regex, prefix or name.

    Unknown names are an error, as is a count other than ``expected``.
    """
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    chosen = [
        c
        for c in df.columns
        if c in names or any(c.startswith(p) for p in prefixes) or (pattern is not None and re.search(pattern, c))
    ]
    if expected is not None and len(chosen) != expected:
        raise ValueError(f"expected {expected} columns, found {len(chosen)}: {chosen}")
    return df.select(*[f"`{c}`" for c in df.columns if (c in chosen) != drop])


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange the roles of two columns."""
    roles = {a: b, b: a}
    return df.select(*[F.col(f"`{roles.get(c, c)}`").alias(c) for c in df.columns])
