"""Comparison of a secondary source with the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrflow.functions.codes import match_key_name, match_key_simc
from addrflow.sources.scratch import kept

from .relational import match_by_key, union_all


def registry_keys(points: DataFrame, localities: DataFrame, streets: DataFrame) -> DataFrame:
    """Both keys of every active point, with its postal code."""
    loc = localities.select("simc", F.col("name_norm").alias("locality_norm"))
    road = streets.select("street_id", F.col("name_norm").alias("street_norm"))
    joined = points.where("withdrawn IS NULL").join(loc, "simc").join(road, "street_id", "left")
    return joined.select(match_key_simc(F.col("simc"), F.col("street_norm"), F.col("number_key")).alias("key_simc"), match_key_name(F.col("locality_norm"), F.col("street_norm"), F.col("number_key")).alias("key_name"), F.col("postal_code").alias("registry_code"))


def source_keys(source: DataFrame) -> DataFrame:
    """The same keys of a secondary source's rows."""
    return source.withColumn("key_simc", match_key_simc(F.col("simc"), F.col("street_norm"), F.col("number_key"))).withColumn("key_name", match_key_name(F.col("locality_norm"), F.col("street_norm"), F.col("number_key")))


def gaps(source: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of the source whose address the registry lacks."""
    return match_by_key(source, registry.select("key_simc", "key_name"), "key_simc", "key_name", "left_anti")


def diff_totals(source: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: in_source, in_registry, common, only_source, share of gaps."""
    left = source.agg(F.count("*").alias("in_source")).withColumn("_k", F.lit("x"))
    right = registry.agg(F.count("*").alias("in_registry")).withColumn("_k", F.lit("x"))
    only = gaps(source, registry).agg(F.count("*").alias("only_source")).withColumn("_k", F.lit("x"))
    out = left.join(right, "_k").join(only, "_k")
    return out.select("in_source", "in_registry", (F.col("in_source") - F.col("only_source")).alias("common"), "only_source", (F.col("only_source").cast("double") / F.greatest(F.col("in_source"), F.lit(1))).alias("gap_share"))


def diff_sample(source: DataFrame, registry: DataFrame, n: int = 25) -> DataFrame:
    """The first gaps by id (D3)."""
    return gaps(source, registry).orderBy("id").limit(n)


def diff_postal(source: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs with the same address and different postal codes."""
    return match_by_key(source.where("postal_code IS NOT NULL"), registry.where("registry_code IS NOT NULL"), "key_simc", "key_name", "inner").where("postal_code <> registry_code")


def diff_communes(source: DataFrame, registry: DataFrame, localities: DataFrame, n: int = 10) -> DataFrame:
    """Communes with the most gaps (D5, A5); rows without a known locality are counted under 'unknown'."""
    joined = gaps(source, registry).join(localities.select("simc", "terc"), "simc", "left")
    return joined.groupBy(F.coalesce("terc", F.lit("unknown")).alias("terc")).agg(F.count("*").alias("gaps")).orderBy(F.desc("gaps"), "terc").limit(n)


def compared(source: DataFrame, registry: DataFrame) -> DataFrame:
    """Each source row with ``known``, whether the registry has its address, and ``pairs``, the registry rows there whose
    postal code differs: one join for all reports (D2 to D5).

    The registry is counted by key and code first, so that an address that many rows share joins once."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array("key_simc", "key_name"))))
    coded = registry.select(keys.alias("key"), "registry_code").groupBy("key", "registry_code").agg(F.count("*").alias("n"))
    # An address has as many codes as there are postal codes at most.
    codes = F.map_from_entries(F.collect_list(F.when(F.col("registry_code").isNotNull(), F.struct("registry_code", "n"))))
    right = coded.groupBy("key").agg(F.sum(F.when(F.col("registry_code").isNotNull(), F.col("n")).otherwise(0)).alias("coded"), codes.alias("codes"))
    joined = source.withColumn("key", F.coalesce("key_simc", "key_name")).join(right, "key", "left")
    other = F.col("coded") - F.coalesce(F.try_element_at("codes", F.col("postal_code")), F.lit(0))
    pairs = F.coalesce(F.when(F.col("postal_code").isNotNull(), other), F.lit(0))
    return joined.select(*source.columns, F.col("coded").isNotNull().alias("known"), pairs.alias("pairs"))


def diff_report(source: DataFrame, registry: DataFrame, localities: DataFrame, n_sample: int = 25, n_communes: int = 10, max_share: float = 0.05) -> DataFrame:
    """The whole comparison as (section, item, value, warning) rows: totals, the first gaps by id, the communes with the most
    gaps (D6).

    Each side is made once and joined once; sums by commune give the totals, too.  Warnings: an empty source, more gaps
    than ``max_share``, pairs with differing codes."""
    right = kept("registry", registry.select("key_simc", "key_name", "registry_code"))
    rows = compared(source, right).join(localities.select("simc", "terc").dropDuplicates(["simc"]), "simc", "left")
    rows = kept("compared", rows.select("id", "known", "pairs", F.coalesce("terc", F.lit("unknown")).alias("terc")))
    communes = kept("communes", rows.groupBy("terc").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("gaps"), F.sum("pairs").alias("pairs")))
    sums = communes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "gaps", "pairs"))).join(right.agg(F.count("*").alias("registry")), F.lit(True))
    share = F.col("gaps") / F.greatest("n", F.lit(1))
    line = lambda item, value, warning: F.struct(F.lit("totals").alias("section"), F.lit(item).alias("item"), value.cast("double").alias("value"), warning.alias("warning"))
    never = F.lit(False)
    totals = sums.select(F.inline(F.array(
        line("in_source", F.col("n"), F.col("n") == 0), line("in_registry", F.col("registry"), never), line("common", F.col("n") - F.col("gaps"), never),
        line("only_source", F.col("gaps"), never), line("gap_share", share, share > max_share), line("postal_pairs", F.col("pairs"), F.col("pairs") > 0),
    )))
    sample = rows.where("NOT known").orderBy("id").limit(n_sample).select(F.lit("first gaps").alias("section"), F.col("id").cast("string").alias("item"), F.lit(1.0).alias("value"), never.alias("warning"))
    worst = communes.where("gaps > 0").orderBy(F.desc("gaps"), "terc").limit(n_communes).select(F.lit("communes").alias("section"), F.col("terc").alias("item"), F.col("gaps").cast("double").alias("value"), never.alias("warning"))
    return union_all(totals, sample, worst)
