"""Usage, quotas, rate limits and keys over request events.

Events have event_id, ts, key_id, client_id, route, status, ms, items; keys and clients are small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrflow.functions.codes import api_key_parts, billing_period, billing_units


def billed(events: DataFrame) -> DataFrame:
    """Events with units and period; server errors are not billed."""
    return events.where("status < 500").withColumn("units", billing_units(F.col("route"), F.col("items"))).withColumn("period", billing_period(F.col("ts")))


def usage_agg(events: DataFrame) -> DataFrame:
    """Requests and units of each key and month."""
    return billed(events).groupBy("key_id", "period").agg(F.count("*").alias("requests"), F.sum("units").alias("units"))


def add_usage(total: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals by (batch_id, key, month) with a new batch; a batch seen before replaces itself, so a retry adds nothing."""
    rest = total.join(delta.select("batch_id").distinct(), "batch_id", "left_anti")
    return rest.unionByName(delta)


def monthly_usage(usage: DataFrame, keys: DataFrame, period) -> DataFrame:
    """Units of each client in a month."""
    return usage.where(F.col("period") == F.lit(period).cast("date")).join(keys.select("key_id", "client_id"), "key_id").groupBy("client_id").agg(F.sum("units").alias("units"), F.sum("requests").alias("requests"))


def quota_flags(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Events with the units billed before them in the month, and whether the quota rejects them.

    A busy client's month is no single task: units are summed by hour first, then only the events of an hour are put in
    order."""
    own = billed(events).withColumn("_hour", F.date_trunc("hour", "ts"))
    hours = own.groupBy("client_id", "period", "_hour").agg(F.sum("units").alias("_units"))
    earlier = Window.partitionBy("client_id", "period").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("client_id", "period", "_hour", F.coalesce(F.sum("_units").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("client_id", "period", "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = own.withColumn("_inside", F.coalesce(F.sum("units").over(before), F.lit(0))).join(hours, ["client_id", "period", "_hour"])
    counted = counted.withColumn("used_before", F.col("_base") + F.col("_inside")).drop("_hour", "_base", "_inside")
    out = counted.join(clients.select("client_id", "monthly_quota"), "client_id")
    return out.withColumn("rejected", F.coalesce(F.col("used_before") >= F.col("monthly_quota"), F.lit(False)))


def key_state(keys: DataFrame, clients: DataFrame, as_of) -> DataFrame:
    """revoked, suspended, expired, not_yet_valid or active for each key, by the first that holds."""
    t = F.lit(as_of).cast("timestamp")
    state = F.when(F.col("revoked_at") <= t, "revoked").when(F.col("suspended_at") <= t, "suspended").when(F.col("valid_to") <= t, "expired").when(F.col("valid_from") > t, "not_yet_valid").otherwise("active")
    return keys.join(clients.select("client_id", "suspended_at"), "client_id").withColumn("state", state)


def address_limit_flags(events: DataFrame, per_minute: int = 60) -> DataFrame:
    """Minutes in which an address made more requests than ``per_minute`` without a verified client."""
    seen = events.where("client_id IS NULL").groupBy("address", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"))
    return seen.withColumn("limited", F.col("requests") > per_minute)


def rate_limit_flags(events: DataFrame, keys: DataFrame, clients: DataFrame) -> DataFrame:
    """Minutes in which a client made more requests than the lesser of its and the key's limit."""
    limits = keys.join(clients.select("client_id", F.col("per_minute").alias("_client")), "client_id").groupBy("client_id").agg(F.min(F.least("per_minute", "_client")).alias("per_minute_limit"))
    seen = events.groupBy("client_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"))
    return seen.join(limits, "client_id").withColumn("limited", F.col("requests") > F.col("per_minute_limit"))


def key_report(keys: DataFrame, usage: DataFrame, period) -> DataFrame:
    """Keys with their usage in a month and the key they replace; never the hash."""
    now = usage.where(F.col("period") == F.lit(period).cast("date")).select("key_id", "requests", "units")
    old = keys.select(F.col("key_id").alias("_old"), F.col("prefix").alias("replaces_prefix"))
    out = keys.join(now, "key_id", "left").join(old, keys["replaces_id"] == F.col("_old"), "left")
    return out.select("key_id", "client_id", "prefix", "valid_from", "valid_to", "replaces_id", "replaces_prefix", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("units", F.lit(0)).alias("units"))


def change_marker(keys: DataFrame, clients: DataFrame) -> DataFrame:
    """The latest change of two tables; a replica reloads only when it has moved."""
    a = keys.agg(F.max("valid_from").alias("a"), F.max("revoked_at").alias("b")).withColumn("_k", F.lit("x"))
    b = clients.agg(F.max("suspended_at").alias("c")).withColumn("_k", F.lit("x"))
    return a.join(b, "_k").select(F.greatest("a", "b", "c").alias("marker"))


def expiring_keys(keys: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Keys in force that end within ``days`` (U8)."""
    t = F.lit(as_of).cast("timestamp")
    return keys.where(F.col("revoked_at").isNull() & F.col("valid_to").between(t, t + F.make_dt_interval(F.lit(days))))


def keys_by_pepper(keys: DataFrame) -> DataFrame:
    """Keys not revoked for each pepper version."""
    return keys.where("revoked_at IS NULL").groupBy("pepper_version").agg(F.count("*").alias("keys"))


def find_keys(keys: DataFrame, clients: DataFrame, fragment: str) -> DataFrame:
    """Keys of clients with a fragment in their name (U8)."""
    hit = clients.where(F.contains(F.lower("client_name"), F.lit(fragment.lower())))
    return keys.join(hit.select("client_id", "client_name"), "client_id").select("key_id", "client_id", "client_name", "prefix")


def scan_leaked_keys(df: DataFrame, text_col: str, id_col: str, live: str = "adr_live_", test: str = "adr_test_", secret_chars: int = 32) -> DataFrame:
    """Keys with a right checksum in any text."""
    pattern = rf"(?:{live}|{test})[A-Za-z0-9_-]{{{secret_chars}}}_[A-Za-z0-9_-]{{6}}"
    found = df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("key"))
    return found.withColumn("parts", api_key_parts(F.col("key"), live, test, secret_chars)).where("parts IS NOT NULL").select(id_col, F.col("parts.environment").alias("environment"), F.sha2("key", 256).alias("key_sha256"))


def outcome(status: Column) -> Column:
    """Closed set of outcomes."""
    return F.when(status < 400, "ok").when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 429, "limited").when(status < 500, "bad_request").otherwise("error")


def auth_outcomes(events: DataFrame) -> DataFrame:
    """Requests by outcome."""
    return events.groupBy(outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


def throttle(events: DataFrame, seconds: int = 1) -> DataFrame:
    """At most one event of each outcome in each interval, the first."""
    slot = F.floor(F.unix_seconds("ts") / seconds) * seconds
    keyed = events.where("status >= 400").withColumn("outcome", outcome(F.col("status"))).withColumn("slot", slot)
    return keyed.groupBy("outcome", "slot").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("outcome", "slot", F.col("first.event_id").alias("event_id"))
