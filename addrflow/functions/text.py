"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the plain letters they are compared as.
MARKED = "ąćęłńóśźżáàâäãåčçďéèêëěíìîïľĺňñôöõòřŕšťúùûüůýžøđ"
PLAIN = "acelnoszzaaaaaaccdeeeeeiiiillnnoooorrstuuuuuyzod"


def fold(s: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(s), MARKED, PLAIN)


def normalize_text(s: Column) -> Column:
    """Lower case, no marks, only letters a-z and digits, single blanks."""
    return F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", " "))


def clean_text(s: Column) -> Column:
    """Single blanks, case and marks kept; a no-break space is a blank."""
    return F.trim(F.regexp_replace(s, r"[\s ]+", " "))


def title_case(s: Column) -> Column:
    """Names in capitals as title case, Roman numerals kept; mixed case as it is."""
    word = F.transform(F.split(s, " "), lambda w: F.when(F.rlike(w, F.lit("^(?=[IVXL])(X{0,3}|XL|L)(IX|IV|V?I{0,3})$")), w).otherwise(F.initcap(F.lower(w))))
    return F.when((F.upper(s) == s) & (F.lower(s) != s), F.array_join(word, " ")).otherwise(s)


def tokenize(s: Column) -> Column:
    """Normalised words."""
    return F.filter(F.split(normalize_text(s), " "), lambda t: t != "")


def levenshtein_max(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance up to ``most``, null beyond it."""
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1))


def not_empty(s: Column) -> Column:
    """Trimmed text, null if nothing is left; every ingested text goes through this."""
    return F.nullif(F.trim(s), F.lit(""))
