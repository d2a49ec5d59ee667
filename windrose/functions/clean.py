"""Cleaning of text columns: missing-value words, validation, coercion, repeated header rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for a missing value; those of web tables besides; airport and runway codes.
MISSING = ("", "nan", "none", "na", "n/a", "null")
MISSING_ON_PAGES = (*MISSING, "—", "unknown")
IATA = "^[A-Z]{3}$"
RUNWAY = "^(0[1-9]|[1-3][0-9])[LR]$"


def no_missing_words(column: Column, words: Sequence[str] = MISSING) -> Column:
    trimmed = F.trim(column)
    return F.when(F.lower(trimmed).isin(*words), None).otherwise(trimmed)


def normalised(df: DataFrame, words: Sequence[str] = MISSING) -> DataFrame:
    """Every string column trimmed, missing-value words as null."""
    return df.select(*(no_missing_words(F.col(f"`{c}`"), words).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))


def without_header_rows(df: DataFrame) -> DataFrame:
    """Rows in which no cell repeats its column's name."""
    same = [F.coalesce(F.upper(F.trim(F.col(f"`{c}`").cast("string"))) == c.upper(), F.lit(False)) for c in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, same, F.lit(False)))


def completed(df: DataFrame, columns: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """``df`` with every named column: renamed from its older name, or null."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns if c not in df.columns))


def valid_or_null(column: Column, pattern: str) -> Column:
    value = F.upper(F.trim(column))
    return F.when(value.rlike(pattern), value)


def as_flag(column: Column, default: bool = False) -> Column:
    value = F.lower(F.trim(column.cast("string")))
    return F.coalesce(F.when(value.isin("true", "1", "yes"), True).when(value.isin("false", "0", "no"), False), F.lit(default))


def flight_number(column: Column) -> Column:
    """Numbers of the renamed carrier BL under its present code VN."""
    value = F.upper(F.trim(column))
    return F.when(value.startswith("BL"), F.concat(F.lit("VN"), F.substring(value, F.lit(3), F.length(value)))).otherwise(value)


def clipped(column: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(column < low, low).when(column > high, high).otherwise(column)


def dropped(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` without the columns of exactly these names, and the names that it had."""
    present = [c for c in columns if c in df.columns]
    return df.drop(*present), present


def found_column(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The column that one of the names means: the same but for case and signs, else the first that holds one."""
    plain = lambda name: re.sub("[^a-z0-9]", "", name.lower())
    names = [plain(w) for w in wanted]
    same = (c for w in names for c in columns if plain(c) == w)
    holding = (c for w in names for c in columns if w in plain(c))
    return next(same, None) or next(holding, None)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with every named column; where it is absent or null, its default."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
