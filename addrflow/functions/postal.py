"""Postal codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Codes that are typed where none is known.
PLACEHOLDERS = ("00-000", "99-999", "11-111", "12-345")


def is_valid_postal(s: Column) -> Column:
    return F.rlike(F.trim(s), F.lit("^[0-9]{2}-[0-9]{3}$"))


def normalize_postal(s: Column) -> Column:
    """NN-NNN from any text with exactly five digits, else null."""
    d = F.regexp_replace(s, "[^0-9]", "")
    return F.when(F.length(d) == 5, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 3)))


def is_placeholder_postal(s: Column) -> Column:
    return s.isin(*PLACEHOLDERS)


def extract_postal(s: Column) -> Column:
    """struct(code, index, length) of the first code in a text.

    A code with a hyphen comes first; five bare digits count only apart from digits and slashes, and not if they make a
    placeholder.  ``index`` counts from 0."""
    dashed, plain = r"(?<![\p{L}0-9_])[0-9]{2}-[0-9]{3}(?![\p{L}0-9_])", r"(?<![0-9/])[0-9]{5}(?![0-9/])"
    def bare(p: Column) -> Column:
        code = normalize_postal(p)
        return F.when((p != "") & ~is_placeholder_postal(code), F.struct(code.alias("code"), _at(s, plain).alias("index"), F.lit(5).alias("length")))

    def choose(d: Column) -> Column:
        return F.when(d != "", F.struct(d.alias("code"), _at(s, dashed).alias("index"), F.lit(6).alias("length"))).otherwise(let(F.regexp_extract(s, plain, 0), bare))

    return let(F.regexp_extract(s, dashed, 0), choose)


def _at(s: Column, pattern: str) -> Column:
    """Characters before the first match."""
    return F.length(F.regexp_extract(s, f"^(.*?){pattern}", 1))
