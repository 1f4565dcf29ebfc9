"""House numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_L = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"
#: Ways of writing that there is no number; words before a flat.
_NONE = r"(?i)^(b\.?\s?n\.?|bn|brak|nd|n/d|0+|[-.\s]+)$"
_FLAT_WORD = r"(?i)(?:mieszkanie|(?:mieszk|lok|m)\.?)(?=\s*[0-9])"
#: Stands for a flat word while a number is read; no number holds it.
_MARK = "\ue000"


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def building_sort_key(s: Column) -> Column:
    """Natural order: every run of digits padded to six, lower case."""
    runs = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), F.lpad(x, F.greatest(F.lit(6), F.length(x)), F.lit("0"))).otherwise(x))
    return F.lower(F.array_join(padded, ""))


def building_key(s: Column) -> Column:
    """Key for comparisons: lower case; digits, letters, / and - only."""
    return F.regexp_replace(F.lower(s), "[^0-9a-ząćęłńóśźż/-]", "")


def canonical_building(s: Column) -> Column:
    """No blanks; a letter after a digit is a capital."""
    parts = F.regexp_extract_all(_bare(F.trim(s)), F.lit("([0-9]+|[^0-9])"), F.lit(1))
    return let(parts, lambda runs: F.array_join(F.transform(runs, lambda x, i: F.when((i > 0) & F.rlike(F.get(runs, i - 1), F.lit("^[0-9]")), F.upper(x)).otherwise(x)), ""))


def canonical_flat(s: Column) -> Column:
    return F.upper(_bare(F.trim(s)))


def _is_part(s: Column) -> Column:
    """Up to five digits and a letter."""
    return F.rlike(s, F.lit(f"^[0-9]{{1,5}}[{_L}]?$"))


def _all_parts(parts: Column, most: int) -> Column:
    return (F.size(parts) <= most) & F.forall(parts, _is_part)


def _is_building(s: Column) -> Column:
    """A part, two parts with a slash, or a range of two, without blanks."""
    return _all_parts(F.split(s, "/"), 2) | _all_parts(F.split(s, "-"), 2)


def looks_like_building_number(s: Column) -> Column:
    """A number, a range or a pair, without a flat."""
    return let(_bare(F.trim(s)), lambda t: ~F.rlike(t, F.lit(_NONE)) & _is_building(t))


def is_garbage_number(s: Column) -> Column:
    """Numbers in snapshots that are no address: lists, "12 do 18", signs only, zeros (M5)."""
    t = F.trim(s)
    return F.coalesce((t == "") | F.rlike(t, F.lit(r"(?i),|\bdo\b|[0-9]\s{2,}[0-9]|^b\.?\s?n\.?$|^[^0-9a-zA-Z]+$|^0+$")), F.lit(True))


def parse_number(s: Column) -> Column:
    """struct(building, flat, ambiguous, alternatives), null if it is no number.

    ``12/14`` is building 12, flat 14, or the corner building 12/14: ambiguous, with the latter as the alternative; only
    the registry can tell."""
    return let(F.regexp_replace(F.trim(s), r"\s+", " "), _reading)


def _reading(t: Column) -> Column:
    """Flat words cut a number in house and flat; without one, slashes do: the last of three parts is a flat, the last of two
    may be."""
    none = F.lit(None).cast("string")

    def result(building: Column, flat: Column = none, doubt: Column | bool = False) -> Column:
        doubt = F.lit(doubt) if isinstance(doubt, bool) else doubt
        other = F.when(doubt, F.array(canonical_building(t))).otherwise(F.array().cast("array<string>"))
        return F.struct(canonical_building(building).alias("building"), canonical_flat(flat).alias("flat"), doubt.alias("ambiguous"), other.alias("alternatives"))

    def cut(x: Column) -> Column:
        house, flat, parts = x["sides"][0], F.get(x["sides"], F.lit(1)), x["parts"]
        slashed = F.when(F.size(parts) == 3, result(F.concat_ws("/", parts[0], F.get(parts, F.lit(1))), F.get(parts, F.lit(2))))
        slashed = slashed.when(F.size(parts) == 2, result(parts[0], F.get(parts, F.lit(1)), ~F.rlike(house, F.lit(f"[{_L}]"))))
        return (
            F.when((t == "") | F.rlike(t, F.lit(_NONE)) | (F.size(x["sides"]) > 2), None)
            # Digits that only a blank parts are two numbers.
            .when(F.rlike(x["end"], F.lit("[0-9] [0-9]")), None)
            .when(flat.isNotNull(), F.when(_is_part(flat) & _is_building(house), result(house, flat)))
            .when(_all_parts(parts, 3), F.when(F.size(parts) == 1, result(house)).otherwise(slashed))
            .when(_is_building(house), result(house))
        )

    sides = F.split(F.regexp_replace(t, _FLAT_WORD, _MARK), _MARK)
    return let(sides, lambda s: let(F.struct(F.transform(s, _bare).alias("sides"), F.split(_bare(s[0]), "/").alias("parts"), F.element_at(s, -1).alias("end")), cut))
