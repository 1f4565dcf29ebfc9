"""A synthetic registry of any size, the same whatever the partitioning (G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrflow.functions.numbers import building_key, building_sort_key
from addrflow.functions.text import normalize_text

_FIRST = "Nowa Stara Wielka Mala Dolna Gorna Biala Czarna Zielona Dluga".split()
_SECOND = "Wies Wola Gora Dabrowa Laka Kepa Brzezina Huta Rzeka Polana".split()
_GIVEN = "Jana Adama Tadeusza Marii Anny Piotra Pawla Stefana".split()
_SURNAME = "Kowalskiego Nowaka Zielinskiego Lisa Wilka Maja Sokola Klona".split()


def unit(c: Column, salt: str) -> Column:
    """A number in [0, 1) that a key and a salt fix."""
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0


def choice(c: Column, salt: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(unit(c, salt) * len(values)) + 1).cast("int"))


def zipf(u: Column, n: int) -> Column:
    """A rank below ``n`` by the inverse of Zipf's distribution: rank r comes in proportion to log((r + 2) / (r + 1)), nearly
    1 / (r + 1.5)."""
    return F.least(F.floor(F.pow(F.lit(float(n + 1)), u) - 1), F.lit(n - 1)).cast("long")


def localities(spark: SparkSession, n: int) -> DataFrame:
    """55 % names of two words, 30 % with streets."""
    i = F.col("id")
    two = unit(i, "two") < 0.55
    name = F.when(two, F.concat_ws(" ", choice(i, "a", _FIRST), choice(i, "b", _SECOND))).otherwise(choice(i, "b", _SECOND))
    df = spark.range(n).select(F.lpad(i.cast("string"), 7, "0").alias("simc"), name.alias("name"), (unit(i, "s") < 0.3).alias("has_streets"), F.concat(F.lpad((i % 16 + 1).cast("string"), 2, "0"), F.lpad((i % 20 + 1).cast("string"), 2, "0"), F.lpad((i % 8 + 1).cast("string"), 2, "0"), F.lit("2")).alias("terc"), (14.2 + unit(i, "x") * 9.8).alias("lon"), (49.1 + unit(i, "y") * 5.6).alias("lat"))
    return df.withColumn("name_norm", normalize_text(F.col("name")))


def streets(spark: SparkSession, n: int, n_localities: int) -> DataFrame:
    """35 % named after persons; one for each (locality, name)."""
    i = F.col("id")
    patron = unit(i, "p") < 0.35
    name = F.when(patron, F.concat_ws(" ", choice(i, "g", _GIVEN), choice(i, "n", _SURNAME))).otherwise(F.concat(choice(i, "f", _FIRST), F.lit("-"), (i % 97).cast("string")))
    place = F.floor(F.pow(unit(i, "l"), 2.0) * n_localities).cast("long")
    df = spark.range(n).select(F.lpad(place.cast("string"), 7, "0").alias("simc"), F.lpad((i % 100_000).cast("string"), 5, "0").alias("sym_ul"), F.lit("ul.").alias("kind"), name.alias("name"))
    return df.dropDuplicates(["simc", "name"]).withColumn("street_id", F.concat_ws("-", "simc", "name")).withColumn("name_norm", normalize_text(F.col("name")))


def points(spark: SparkSession, n: int, n_localities: int) -> DataFrame:
    """Zipf-like localities; 8 % numbers with letters, 3 % of corners, 2 % under construction."""
    i = F.col("id")
    place = zipf(unit(i, "l"), n_localities)
    number = F.floor(unit(i, "n") * 200).cast("int") + 1
    text = F.when(unit(i, "k") < 0.08, F.concat(number.cast("string"), choice(i, "c", list("ABCD")))).when(unit(i, "k") < 0.11, F.concat(number.cast("string"), F.lit("/"), (number + 2).cast("string"))).otherwise(number.cast("string"))
    df = spark.range(n).select(F.concat(F.lit("PA-"), F.lpad(i.cast("string"), 9, "0")).alias("point_id"), F.lpad(place.cast("string"), 7, "0").alias("simc"), text.alias("number"), F.when(unit(i, "s") < 0.02, "wTrakcieBudowy").otherwise("istniejacy").alias("status"), (14.2 + unit(i, "x") * 9.8).alias("lon"), (49.1 + unit(i, "y") * 5.6).alias("lat"))
    return df.withColumn("number_key", building_key(F.col("number"))).withColumn("number_sort", building_sort_key(F.col("number")))


def registry(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """Staged tables of a whole registry with ``n`` points: unit, locality, street, point.

    One locality for 85 points, one street for 26; 35 % of the points have no street.  A street's locality is a function of
    its number, so that points know both without a join."""
    n_localities, n_streets = max(16, n // 85), max(16, n // 26)
    i = F.col("id")
    none = F.lit(None).cast("timestamp").alias("withdrawn")
    terc = lambda place: F.concat(F.lpad((place % 16 + 1).cast("string"), 2, "0"), F.lpad((place % 20 + 1).cast("string"), 2, "0"), F.lpad((place % 8 + 1).cast("string"), 2, "0"), F.lit("2"))
    simc = lambda place: F.lpad(place.cast("string"), 7, "0")
    home = lambda street: zipf(unit(street, "home"), n_localities)
    code = lambda street: F.lpad((street % 100_000).cast("string"), 5, "0")

    place = localities(spark, n_localities).select("simc", "name", "name_norm", F.lit(1).alias("kind"), "terc", "lon", "lat", F.concat(F.lit("M-"), "simc").alias("gml_id"), none)
    patron = unit(i, "p") < 0.35
    name = F.when(patron, F.concat_ws(" ", choice(i, "g", _GIVEN), choice(i, "n", _SURNAME))).otherwise(F.concat_ws(" ", choice(i, "f", _FIRST), choice(i, "s", _SECOND)))
    road = spark.range(n_streets).select(F.concat_ws("-", simc(home(i)), code(i)).alias("street_id"), simc(home(i)).alias("simc"), code(i).alias("sym_ul"), F.lit("ul.").alias("kind"), name.alias("name"), F.concat(F.lit("U-"), i.cast("string")).alias("gml_id"), F.lit("official").alias("source"), none)
    road = road.withColumn("name_norm", normalize_text(F.col("name")))
    spot = points(spark, n, n_localities).select("point_id", "number", "number_key", "number_sort", "status", "lon", "lat", F.substring("point_id", 4, 9).cast("long").alias("id"))
    street = zipf(unit(i, "street"), n_streets)
    with_street = unit(i, "without") >= 0.35
    own = F.when(with_street, home(street)).otherwise(zipf(unit(i, "l"), n_localities))
    spot = spot.withColumn("place", own).withColumn("street", F.when(with_street, street))
    spot = spot.select("point_id", simc(F.col("place")).alias("simc"), terc(F.col("place")).alias("terc"), F.substring(terc(F.col("place")), 1, 2).alias("region"), F.lit("primary").alias("source"), F.when(F.col("street").isNotNull(), F.concat_ws("-", simc(F.col("place")), code(F.col("street")))).alias("street_id"), "number", "number_key", "number_sort", F.format_string("%02d-%03d", F.col("place") % 90 + 10, F.col("place") % 900 + 100).alias("postal_code"), "status", "lon", "lat", none, F.xxhash64("number", "street", "status").cast("string").alias("hash"))
    low = spark.range(16).select((i + 1).alias("w"))
    level = [low.select(F.concat(F.lpad(F.col("w").cast("string"), 2, "0"), F.lit("00000")).alias("terc"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_terc"))]
    communes = place.select("terc").distinct()
    level.append(communes.select(F.concat(F.substring("terc", 1, 4), F.lit("000")).alias("terc"), F.lit(2).alias("level"), F.concat(F.substring("terc", 1, 2), F.lit("00000")).alias("parent_terc")).distinct())
    level.append(communes.select("terc", F.lit(3).alias("level"), F.concat(F.substring("terc", 1, 4), F.lit("000")).alias("parent_terc")))
    units = level[0].unionByName(level[1]).unionByName(level[2]).withColumn("name", F.concat(F.lit("unit "), "terc"))
    return {"unit": units, "locality": place, "street": road, "point": spot}
