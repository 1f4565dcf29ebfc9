"""Readers of catalogue files and profile-driven tables; everything is read as text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrflow.functions.codes import build_terc, pad
from addrflow.functions.text import normalize_text, not_empty
from addrflow.operators.relational import distinct_on, least_values


def sniff_csv(spark: SparkSession, path: str) -> dict[str, str]:
    """Separator and cleaned column names from the header line."""
    row = spark.read.text(path).limit(1).first()
    header = (row[0] if row else "").lstrip("﻿")
    sep = max(";,\t", key=lambda s: (header.count(s), -";,\t".index(s)))
    return {"sep": sep, "header": header}


def header_key(name: str) -> str:
    """Header names compare without case, marks and punctuation."""
    import unicodedata

    plain = unicodedata.normalize("NFD", name.replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in plain.lower() if c.isalnum())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    options = sniff_csv(spark, path)
    df = spark.read.option("header", True).option("sep", options["sep"]).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def _pick(df: DataFrame, *names: str) -> Column:
    """The first existing column of some candidate names, null without one."""
    have = {header_key(c): c for c in df.columns}
    for n in names:
        if header_key(n) in have:
            return not_empty(F.col(f"`{have[header_key(n)]}`"))
    return F.lit(None).cast("string")


def terc_rows(df: DataFrame) -> DataFrame:
    """Units: terc, name, kind, parent_terc, level, as_of."""
    code = build_terc(_pick(df, "WOJ"), _pick(df, "POW"), _pick(df, "GMI"), _pick(df, "RODZ"))
    return df.select(code["terc"].alias("terc"), _pick(df, "NAZWA").alias("name"), _pick(df, "RODZ").cast("smallint").alias("kind"), code["parent_terc"].alias("parent_terc"), code["level"].cast("smallint").alias("level"), _pick(df, "STAN_NA").cast("date").alias("as_of"))


def simc_rows(df: DataFrame) -> DataFrame:
    """Localities: simc, name, name_norm, kind, terc, parent_simc."""
    simc = pad(_pick(df, "SYM"), 7)
    terc = F.concat(pad(_pick(df, "WOJ"), 2), pad(_pick(df, "POW"), 2), pad(_pick(df, "GMI"), 2), _pick(df, "RODZ_GMI"))
    return df.select(simc.alias("simc"), _pick(df, "NAZWA").alias("name"), normalize_text(_pick(df, "NAZWA")).alias("name_norm"), _pick(df, "RM").cast("smallint").alias("kind"), terc.alias("terc"), F.coalesce(pad(_pick(df, "SYMPOD"), 7), simc).alias("parent_simc"))


def ulic_rows(df: DataFrame) -> DataFrame:
    """Streets: simc, sym_ul, kind, name (second part first), name_1, name_2."""
    name = F.concat_ws(" ", _pick(df, "NAZWA_2"), _pick(df, "NAZWA_1"))
    return df.select(pad(_pick(df, "SYM"), 7).alias("simc"), pad(_pick(df, "SYM_UL"), 5).alias("sym_ul"), _pick(df, "CECHA").alias("kind"), name.alias("name"), normalize_text(name).alias("name_norm"), _pick(df, "NAZWA_1").alias("name_1"), _pick(df, "NAZWA_2").alias("name_2"))


def wmrodz_rows(df: DataFrame) -> DataFrame:
    """Kinds of localities: code, name."""
    return df.select(_pick(df, "RM").cast("smallint").alias("code"), _pick(df, "NAZWA_RM").alias("name"))


CATALOGUES = {"terc": terc_rows, "simc": simc_rows, "ulic": ulic_rows, "wmrodz": wmrodz_rows}


def read_catalogue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A catalogue from CSV or from XML rows of named columns, whichever the file is."""
    first = spark.read.text(path).limit(1).first()
    if first and first[0].lstrip("﻿").lstrip().startswith("<"):
        # Cut at the rows' closing tags, so that one large file is read by many tasks.
        body = F.regexp_extract("value", r"(?s)(<row[\s>].*)$", 1)
        parts = spark.read.option("lineSep", "</row>").text(path).select(body.alias("body")).where("body <> ''")
        rows = parts.select(F.from_xml(F.concat("body", F.lit("</row>")), "col array<struct<_name:string,_VALUE:string>>").alias("r")).select("r.*")
        names = {"terc": "WOJ POW GMI RODZ NAZWA NAZWA_DOD STAN_NA", "simc": "WOJ POW GMI RODZ_GMI RM MZ NAZWA SYM SYMPOD STAN_NA", "ulic": "WOJ POW GMI RODZ_GMI SYM SYM_UL CECHA NAZWA_1 NAZWA_2 STAN_NA", "wmrodz": "RM NAZWA_RM STAN_NA"}[kind].split()
        values = F.map_from_entries(F.transform("col", lambda c: F.struct(c["_name"], c["_VALUE"])))
        df = rows.select(values.alias("m")).select(*(F.try_element_at("m", F.lit(n)).alias(n) for n in names))
    else:
        df = read_csv(spark, path)
    return CATALOGUES[kind](df)


def attach_units(localities: DataFrame, units: DataFrame) -> DataFrame:
    """Localities with ``unit_terc``: their code if the units list it, else the whole commune with the same six digits.

    Mixed communes list parts under codes of their own; of several fits the least counts."""
    own = units.where("level = 3").select(F.col("terc").alias("_full"), F.substring("terc", 1, 6).alias("_six"))
    six = own.groupBy("_six").agg(F.min("_full").alias("_least"))
    out = localities.join(own.select("_full"), F.col("terc") == F.col("_full"), "left").join(six, F.substring("terc", 1, 6) == F.col("_six"), "left")
    return out.withColumn("unit_terc", F.coalesce("_full", "_least")).drop("_full", "_six", "_least")


def load_teryt(spark: SparkSession, terc: str, simc: str, ulic: str, wmrodz: str) -> dict[str, DataFrame]:
    """The official catalogues as registry tables: units, localities, streets, kinds, and ``left_out`` (reason, n).

    Of a code that a file lists twice the newest unit counts, else the least name.  A locality has the commune that lists it,
    or the whole commune with its six digits (``attach_units``); localities of no unit and streets of no such locality are
    left out and counted."""
    units = distinct_on(read_catalogue(spark, terc, "terc"), ["terc"], [F.desc_nulls_last("as_of"), F.asc("name")])
    places = distinct_on(read_catalogue(spark, simc, "simc").where("simc IS NOT NULL"), ["simc"], [F.asc("name"), F.asc("terc")])
    placed = attach_units(places, units)
    localities = placed.where("unit_terc IS NOT NULL").withColumn("terc", F.col("unit_terc")).drop("unit_terc")
    named = distinct_on(read_catalogue(spark, ulic, "ulic").where("simc IS NOT NULL AND sym_ul IS NOT NULL"), ["simc", "sym_ul"], [F.asc("name")])
    known = named.join(localities.select("simc", F.lit(True).alias("known")), "simc", "left")
    streets = known.where("known").select(F.concat_ws("-", "simc", "sym_ul").alias("street_id"), *named.columns)
    reasons = (placed.agg(F.count_if(F.col("unit_terc").isNull()).alias("n")).select(F.lit("locality without unit").alias("reason"), "n"), known.agg(F.count_if(F.col("known").isNull()).alias("n")).select(F.lit("street without locality").alias("reason"), "n"))
    return {"unit": units, "locality": localities, "street": streets, "kind": read_catalogue(spark, wmrodz, "wmrodz"), "left_out": reasons[0].unionByName(reasons[1])}


@dataclass(frozen=True)
class Profile:
    """Target column -> candidate column names; ``numbers`` may have a decimal comma."""

    fields: dict[str, tuple[str, ...]]
    numbers: tuple[str, ...] = field(default=())


#: A secondary address source.
COMPARISON = Profile(
    {
        "id": ("ID_PUNKTU", "ID"),
        "simc": ("SIMC", "SYM"),
        "locality": ("MIEJSCOWOSC", "MIEJSC"),
        "sym_ul": ("SYM_UL", "ULIC"),
        "street_kind": ("TYP_ULICY", "CECHA"),
        "street": ("NAZWA_ULICY", "ULICA"),
        "number": ("NR", "NUMER"),
        "postal_code": ("KOD_POCZTOWY", "KOD"),
        "x": ("WSP_X", "X"),
        "y": ("WSP_Y", "Y"),
        "lat": ("LAT",),
        "lon": ("LON",),
    },
    ("x", "y", "lat", "lon"),
)


def apply_profile(df: DataFrame, profile: Profile) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rows with the target columns, report of missing targets and unused columns)."""
    have = {header_key(c): c for c in df.columns}
    chosen = {t: next((have[header_key(n)] for n in names if header_key(n) in have), None) for t, names in profile.fields.items()}
    columns = []
    for target, source in chosen.items():
        c = not_empty(F.col(f"`{source}`")) if source else F.lit(None).cast("string")
        columns.append((F.replace(c, F.lit(","), F.lit(".")).try_cast("double") if target in profile.numbers else c).alias(target))
    report = {"missing": [t for t, s in chosen.items() if s is None], "unused": [c for c in df.columns if c not in chosen.values()]}
    return df.select(*columns), report


def read_tabular(spark: SparkSession, path: str, profile: Profile = COMPARISON) -> tuple[DataFrame, dict[str, list[str]]]:
    return apply_profile(read_csv(spark, path), profile)


def map_comparison(df: DataFrame) -> DataFrame:
    """Rows of a secondary source with normalised names and ``skipped``, the reason why a row can't be compared (M8)."""
    from addrflow.functions.numbers import building_key

    reason = F.when(F.col("number").isNull(), "no number").when(F.col("simc").isNull() & F.col("locality").isNull(), "no locality")
    code = F.when(F.rlike("postal_code", F.lit("^[0-9]{2}-[0-9]{3}$")), F.col("postal_code"))
    return df.withColumn("simc", pad(F.col("simc"), 7)).withColumn("locality_norm", normalize_text(F.col("locality"))).withColumn("street_norm", normalize_text(F.col("street"))).withColumn("number_key", building_key(F.col("number"))).withColumn("postal_code", code).withColumn("skipped", reason)


def discover_tabular(spark: SparkSession, path: str, profile: Profile = COMPARISON, samples: int = 3) -> DataFrame:
    """(column, target, samples) of an unknown table."""
    df = read_csv(spark, path)
    target = {header_key(n): t for t, names in profile.fields.items() for n in names}
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(target.get(header_key(c))).alias("target"), not_empty(F.col(f"`{c}`")).alias("value")) for c in df.columns))).alias("x")).select("x.*")
    return least_values(cells, ["column", "target"], "value", samples).select("column", "target", "samples")


