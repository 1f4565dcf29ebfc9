"""General relational helpers: distinct-on, top-k, change classes, tagged keys and grid joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrflow.functions.geo import degrees_of, distance_m
from addrflow.sources.scratch import kept


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are one group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each partition, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= k)


def least_values(pairs: DataFrame, by: list[str], value: str, k: int, prefix: int = 8) -> DataFrame:
    """For each key ``n``, the rows with a value, and ``samples``, the ``k`` least different values.

    Rows are counted by the first letters of their values: the least values are among those that begin with one of the ``k``
    least beginnings, so that only these are told apart, and nothing holds or sends all values of a key.  ``pairs`` is read
    twice."""
    start = F.substring(value, 1, prefix)
    counted = kept("beginnings", pairs.groupBy(*by, start.alias("_start")).agg(F.count(value).alias("_n")))
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("n"))
    # Beginnings sort as their values do.
    bound = top_k(counted.where("_start IS NOT NULL"), by, [F.asc("_start")], k).groupBy(*by).agg(F.max("_start").alias("_bound"))
    a, b = pairs.where(F.col(value).isNotNull()).alias("a"), bound.alias("b")
    few = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]).where(start <= F.col("_bound")).select("a.*").distinct()
    least = top_k(few, by, [F.asc(value)], k).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"]).alias("samples"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    out = totals.alias("a").join(least.alias("b"), same, "left")
    return out.select(*(F.col(f"a.{c}") for c in by), "n", F.coalesce("samples", F.array().cast(f"array<{pairs.schema[value].dataType.simpleString()}>")).alias("samples"))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def survivors(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Each row with ``survivor``, the id of the first row of its key, without a self-join."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("survivor", F.first(id_col).over(window))


def classify_changes(current: DataFrame, staged: DataFrame, key: str, hash_col: str = "hash", withdrawn: str = "withdrawn") -> DataFrame:
    """One full outer join of two snapshots: (key, cur, new, class), rows as structs.

    Classes: new, restored (withdrawn before), changed (other hash), unchanged, missing, gone (withdrawn and missing)."""
    a = current.select(F.col(key), F.struct(*current.columns).alias("cur"))
    b = staged.select(F.col(key), F.struct(*staged.columns).alias("new"))
    old = F.col(f"cur.{withdrawn}").isNotNull()
    kind = (
        F.when(F.col("cur").isNull(), "new")
        .when(F.col("new").isNull(), F.when(old, "gone").otherwise("missing"))
        .when(old, "restored")
        .when(F.col(f"cur.{hash_col}").eqNullSafe(F.col(f"new.{hash_col}")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").withColumn("class", kind)


def match_by_key(left: DataFrame, right: DataFrame, first: str, second: str, how: str = "left_semi") -> DataFrame:
    """Join on key ``first`` where the left row has it, else on ``second``.

    The left side has one key, the right side both, so it is an equi-join; an OR of two conditions would compare all pairs."""
    tagged = right.select("*", F.explode(F.array_distinct(F.array_compact(F.array(first, second)))).alias("_key")).drop(first, second)
    if how in ("left_semi", "left_anti"):
        tagged = tagged.select("_key").distinct()
    return left.withColumn("_key", F.coalesce(first, second)).join(tagged, "_key", how).drop("_key")


def within_radius(inputs: DataFrame, points: DataFrame, max_m: float) -> DataFrame:
    """Pairs of inputs (lon, lat) and points (plon, plat) up to ``max_m`` metres apart, with ``distance``.

    Points are hashed to grid cells of at least that side; an input looks in its cell and the eight around it."""
    dx, dy = degrees_of(max_m)
    near = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    left = inputs.withColumn("_i", near).withColumn("_j", near).withColumn("_x", F.floor(F.col("lon") / dx) + F.col("_i")).withColumn("_y", F.floor(F.col("lat") / dy) + F.col("_j")).drop("_i", "_j")
    right = points.withColumn("_x", F.floor(F.col("plon") / dx)).withColumn("_y", F.floor(F.col("plat") / dy))
    joined = left.join(right, ["_x", "_y"]).drop("_x", "_y")
    return joined.withColumn("distance", distance_m(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))).where(F.col("distance") <= max_m)
