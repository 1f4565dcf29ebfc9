"""Lookups over published points: numbers, postal codes, localities, reverse geocoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .addresses import active, dominant_postal_code, unit_names
from .nearest import nearest
from .relational import top_k


def numbers(points: DataFrame, owners: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` numbers, in natural order, of each (simc, street_id, prefix) asked for.

    Without a street, the points of the locality that have none."""
    q = owners.select(F.col("simc").alias("_s"), F.col("street_id").alias("_t"), F.coalesce("prefix", F.lit("")).alias("_p"))
    p = active(points)
    joined = p.join(q, (p["simc"] == F.col("_s")) & p["street_id"].eqNullSafe(F.col("_t"))).where(F.startswith("number_key", "_p"))
    best = top_k(joined, ["_s", "_t", "_p"], [F.asc("number_sort"), F.asc("point_id")], limit)
    return best.select("simc", "street_id", F.col("_p").alias("prefix"), "rank", "number", "postal_code", "point_id")


def postal_code_with_fallback(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """Postal code of each (simc, street_id, number_key): the registry's, else the commonest of the street, or of the whole
    locality where no street is given; ``code_source`` says which (L2, L3)."""
    p = active(points)
    exact = p.where("postal_code IS NOT NULL").groupBy("simc", "street_id", "number_key").agg(F.min("postal_code").alias("exact"))
    e = exact.select(F.col("simc").alias("_s"), F.col("street_id").alias("_t"), F.col("number_key").alias("_n"), "exact")
    by_street = dominant_postal_code(p.where("street_id IS NOT NULL"), ["street_id"]).withColumnRenamed("dominant_code", "on_street")
    by_place = dominant_postal_code(p, ["simc"]).withColumnRenamed("dominant_code", "in_place")
    a = addresses
    out = a.join(e, (a["simc"] == F.col("_s")) & a["street_id"].eqNullSafe(F.col("_t")) & (a["number_key"] == F.col("_n")), "left").join(by_street, "street_id", "left").join(by_place, "simc", "left")
    hint = F.when(F.col("street_id").isNotNull(), F.col("on_street")).otherwise(F.col("in_place"))
    label = F.when(F.col("exact").isNotNull(), "registry").when(hint.isNotNull(), "dominant").otherwise("none")
    return out.select(*a.columns, F.coalesce("exact", hint).alias("found_code"), label.alias("code_source"))


def locality_details(localities: DataFrame, units: DataFrame, kinds: DataFrame) -> DataFrame:
    """Localities with the name of their kind and their units (L4)."""
    return active(localities).join(kinds.select(F.col("code").alias("kind"), F.col("name").alias("kind_name")), "kind", "left").join(unit_names(units), "terc", "left")


def reverse_geocode(inputs: DataFrame, points: DataFrame, max_m: float = 500.0, k: int = 5, most_m: float = 5000.0) -> DataFrame:
    """The nearest ``k`` active points within ``max_m`` metres (at most ``most_m``) of each (input_id, lon, lat)."""
    p = active(points).where("lon IS NOT NULL").select("point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    return nearest(inputs, p, k, min(max_m, most_m))
