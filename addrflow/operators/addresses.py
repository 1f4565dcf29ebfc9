"""Joins over the registry: full addresses, references, links to streets, derived counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrflow.functions.codes import pad


def active(df: DataFrame) -> DataFrame:
    """Rows that are not withdrawn (M9)."""
    return df.where(F.col("withdrawn").isNull())


def unit_names(units: DataFrame) -> DataFrame:
    """(terc, commune, county, voivodeship) of every commune, by two joins up the tree."""
    g, p, w = (units.select(F.col("terc").alias(f"{k}_terc"), F.col("name").alias(k), F.col("parent_terc").alias(f"{k}_parent"), F.col("level").alias(f"{k}_level")) for k in ("commune", "county", "voivodeship"))
    tree = g.where("commune_level = 3").join(p.where("county_level = 2"), F.col("commune_parent") == F.col("county_terc"), "left").join(w.where("voivodeship_level = 1"), F.col("county_parent") == F.col("voivodeship_terc"), "left")
    return tree.select(F.col("commune_terc").alias("terc"), "commune", "county", "voivodeship")


def full_address(points: DataFrame, localities: DataFrame, streets: DataFrame, units: DataFrame) -> DataFrame:
    """Every point with its locality, street and units (J1).  Points need a locality and its commune, not a street."""
    loc = localities.select("simc", F.col("name").alias("locality"), "terc")
    road = streets.select("street_id", F.col("kind").alias("street_kind"), F.col("name").alias("street"), "sym_ul")
    return points.join(loc, "simc").join(road, "street_id", "left").join(unit_names(units), "terc")


def resolve_locality_refs(df: DataFrame, localities: DataFrame, ref: str = "locality_ref") -> DataFrame:
    """``simc`` from a reference: the locality with that GML id, else one to seven digits padded."""
    known = localities.where("gml_id IS NOT NULL").select(F.col("gml_id").alias("_id"), F.col("simc").alias("_simc"))
    joined = df.join(known, F.col(ref) == F.col("_id"), "left")
    digits = F.when(F.rlike(ref, F.lit("^[0-9]{1,7}$")), pad(F.col(ref), 7))
    return joined.withColumn("simc", F.coalesce("_simc", digits)).drop("_id", "_simc")


def resolve_refs(points: DataFrame, streets: DataFrame, localities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, streets) with the ``simc`` of their locality references."""
    return tuple(resolve_locality_refs(df.drop("simc"), localities) for df in (points, streets))


def link_streets(points: DataFrame, staged: DataFrame, catalogue: DataFrame, ref: str = "street_ref") -> DataFrame:
    """``street_id`` of each point, by three paths, then only streets that exist.

    1. the staged street with that GML id, in the catalogue by (simc, sym_ul), else by (simc, name, kind);
    2. the staged street of the point's locality whose code the reference's digits are;
    3. the catalogue street of the point's locality with that code."""
    cat = catalogue.select("street_id", "simc", "sym_ul", "name_norm", "kind")
    by_code = cat.where("sym_ul IS NOT NULL").select("simc", "sym_ul", "street_id")
    by_name = cat.groupBy("simc", "name_norm", "kind").agg(F.min("street_id").alias("by_name"))
    via = staged.drop("street_id").join(by_code, ["simc", "sym_ul"], "left").alias("s").join(by_name.alias("n"), (F.col("s.simc") == F.col("n.simc")) & (F.col("s.name_norm") == F.col("n.name_norm")) & F.col("s.kind").eqNullSafe(F.col("n.kind")), "left")
    via = via.select(F.col("s.gml_id").alias("gml_id"), F.col("s.simc").alias("simc"), F.col("s.sym_ul").alias("sym_ul"), F.coalesce("s.street_id", "n.by_name").alias("target"))
    path1 = via.where("gml_id IS NOT NULL AND target IS NOT NULL").groupBy(F.col("gml_id").alias(ref)).agg(F.min("target").alias("_1"))
    path2 = via.where("sym_ul IS NOT NULL AND target IS NOT NULL").groupBy("simc", F.col("sym_ul").alias("_code")).agg(F.min("target").alias("_2"))
    path3 = by_code.groupBy("simc", F.col("sym_ul").alias("_code")).agg(F.min("street_id").alias("_3"))
    code = F.when(F.rlike(ref, F.lit("^[0-9]{1,5}$")), pad(F.col(ref), 5))
    out = points.withColumn("_code", code).join(path1, ref, "left").join(path2, ["simc", "_code"], "left").join(path3, ["simc", "_code"], "left")
    return out.withColumn("street_id", F.coalesce("_1", "_2", "_3")).drop("_code", "_1", "_2", "_3")


def derive_counts(points: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``owners`` with ``n_points``, the active points of each; 0 without any (A1)."""
    n = active(points).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_points"))
    return owners.drop("n_points").join(n, key, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def derive_has_streets(streets: DataFrame, localities: DataFrame) -> DataFrame:
    """``localities`` with ``has_streets`` (A2)."""
    with_streets = active(streets).select("simc").distinct().withColumn("has_streets", F.lit(True))
    return localities.drop("has_streets").join(with_streets, "simc", "left").withColumn("has_streets", F.coalesce("has_streets", F.lit(False)))


def dominant_postal_code(points: DataFrame, by: list[str]) -> DataFrame:
    """The commonest postal code of each group; of equal ones the least."""
    seen = active(points).where("postal_code IS NOT NULL").groupBy(*by, "postal_code").agg(F.count("*").alias("n"))
    return seen.groupBy(*by).agg(F.max_by("postal_code", F.struct("n", F.negative(F.conv(F.regexp_replace("postal_code", "-", ""), 10, 10).cast("long")))).alias("dominant_code"))
