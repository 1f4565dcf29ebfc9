"""Quality gates before a publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrflow.functions.geo import in_poland

#: Thresholds, all of which a caller may change.
DEFAULTS = {"min_rows": 7_500_000, "max_delta": 0.02, "commune_points": 100, "commune_drop": 0.10, "stale_days": 30, "max_without_position": 0.02}


def snapshot_delta(current: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: before, after, added, removed, changed, by one full outer join (Q-2, J11)."""
    a = current.where("withdrawn IS NULL").select("point_id", F.col("hash").alias("h0"), F.lit(1).alias("a"))
    b = staged.select("point_id", F.col("hash").alias("h1"), F.lit(1).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, "point_id", "full_outer").agg(
        F.count("a").alias("before"),
        F.count("b").alias("after"),
        F.count_if(F.col("a").isNull()).alias("added"),
        F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(both & ~F.col("h0").eqNullSafe(F.col("h1"))).alias("changed"),
    )


def commune_drop(current: DataFrame, staged: DataFrame, least: int = 100, share: float = 0.10, limit: int | None = 20) -> DataFrame:
    """Communes with over ``least`` points before that lose more than ``share`` of them (Q-3, A4)."""
    before = current.where("withdrawn IS NULL").groupBy("terc").agg(F.count("*").alias("before"))
    after = staged.groupBy("terc").agg(F.count("*").alias("after"))
    joined = before.join(after, "terc", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    ratio = (F.col("before") - F.col("after")).cast("double") / F.col("before")
    out = joined.withColumn("drop_share", ratio).where((F.col("before") > least) & (F.col("drop_share") > share))
    return out.orderBy(F.desc("drop_share"), "terc").limit(limit) if limit else out


def quality_report(current: DataFrame, staged: DataFrame, thresholds: dict | None = None, last_published_days: float = 0.0, regions: list[str] | None = None) -> DataFrame:
    """One row for each gate: gate, level, ok, value, threshold (Q-1 to Q-6).

    Current points count only in the snapshot's ``regions``.  A report passes if no blocking gate failed."""
    t = DEFAULTS | (thresholds or {})
    if regions is not None:
        current = current.where(F.col("region").isin(*regions))
    delta = snapshot_delta(current, staged)
    drops = commune_drop(current, staged, t["commune_points"], t["commune_drop"], None).agg(F.count("*").alias("communes"))
    shape = staged.agg(
        F.count_if(F.col("lon").isNotNull() & ~in_poland(F.col("lon"), F.col("lat"))).alias("outside"),
        (F.count_if(F.col("lon").isNull()).cast("double") / F.greatest(F.count("*"), F.lit(1))).alias("without"),
    )
    one = delta.withColumn("_k", F.lit("one"))
    for df in (drops, shape):
        one = one.join(df.withColumn("_k", F.lit("one")), "_k")
    size = F.abs(F.col("after") - F.col("before")).cast("double") / F.greatest(F.col("before"), F.lit(1))
    same = (F.col("added") == 0) & (F.col("removed") == 0) & (F.col("changed") == 0) & (F.col("before") > 0)

    def gate(name: str, level: str, ok, value, limit) -> F.Column:
        return F.struct(F.lit(name).alias("gate"), F.lit(level).alias("level"), ok.alias("ok"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))

    gates = F.array(
        gate("minimum_rows", "blocking", F.col("after") >= t["min_rows"], F.col("after"), t["min_rows"]),
        gate("delta_size", "blocking", (F.col("before") == 0) | (size <= t["max_delta"]), size, t["max_delta"]),
        gate("commune_drop", "blocking", F.col("communes") == 0, F.col("communes"), 0),
        gate("zero_delta", "warning", ~(same & F.lit(last_published_days > t["stale_days"])), F.lit(last_published_days), t["stale_days"]),
        gate("outside_country", "blocking", F.col("outside") == 0, F.col("outside"), 0),
        gate("without_position", "warning", F.col("without") <= t["max_without_position"], F.col("without"), t["max_without_position"]),
    )
    return one.select(F.inline(gates))


def passed(report: DataFrame) -> bool:
    return not report.where("level = 'blocking' AND NOT ok").limit(1).count()


def shrink_guard(before: int, after: int, percent: float = 50.0) -> bool:
    """Whether a reload may replace a table: it must not shrink by more than ``percent`` (Q-7)."""
    return before == 0 or after >= before * (1 - percent / 100)


def shrunken(before: DataFrame, after: DataFrame, by: str, percent: float = 50.0) -> DataFrame:
    """Rows of each part of a table before and after a reload, and whether it may replace them (Q-7); new parts always may."""
    a = before.groupBy(by).agg(F.count("*").alias("before"))
    b = after.groupBy(by).agg(F.count("*").alias("after"))
    both = a.join(b, by, "full_outer").select(by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("ok", (F.col("before") == 0) | (F.col("after") >= F.col("before") * (1 - percent / 100)))
