"""Structured Streaming forms of the usage operators over a parquet stream of request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from addrflow.operators.usage import add_usage, billed, outcome


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def meter(events: DataFrame, target: str, checkpoint: str):
    """Adds each micro-batch's usage to ``target``, partitioned by batch id, so that a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = billed(batch).groupBy("key_id", "period").agg(F.count("*").alias("requests"), F.sum("units").alias("units"))
        seen.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metered(spark: SparkSession, target: str) -> DataFrame:
    """Totals of all batches written so far."""
    return spark.read.parquet(target).groupBy("key_id", "period").agg(F.sum("requests").alias("requests"), F.sum("units").alias("units"))


def rate_windows(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Requests of each client and minute with a watermark."""
    return events.withWatermark("ts", lateness).groupBy("client_id", F.window("ts", "1 minute")).agg(F.count("*").alias("requests")).select("client_id", F.col("window.start").alias("minute"), "requests")


def outcome_counts(events: DataFrame) -> DataFrame:
    """Running counts by outcome, for update mode."""
    return events.groupBy(outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


def throttled(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One rejected event of each outcome and second."""
    keyed = events.where("status >= 400").withColumn("outcome", outcome(F.col("status"))).withColumn("slot", F.date_trunc("second", "ts"))
    return keyed.withWatermark("slot", lateness).dropDuplicatesWithinWatermark(["outcome", "slot"])


def quota_stream(events: DataFrame, clients: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """event_id, used_before, rejected of every billed event, with a running total for each client and month.

    Events wait until the watermark has passed them, so that they are counted in the order of their time in whichever
    micro-batch they came; those later than ``lateness`` are left out, as in every windowed stream.  A client's state is
    its units so far and the events that wait; when its month is over it goes."""
    quota = clients.select("client_id", "monthly_quota")
    ends = F.unix_micros(F.add_months(F.col("period"), 1).cast("timestamp")).alias("ends")
    own = billed(events.withWatermark("ts", lateness)).join(quota, "client_id")
    own = own.select("client_id", "period", "ts", "event_id", F.unix_micros("ts").alias("us"), F.col("units").cast("long").alias("units"), F.col("monthly_quota").cast("long").alias("monthly_quota"), ends)
    columns = ["us", "event_id", "units", "monthly_quota"]

    def decide(key, batches, state):
        import pandas as pd

        total, ends, *waiting = state.get if state.exists else (0, 0, *([] for _ in columns))
        parts = [pd.DataFrame(dict(zip(columns, map(list, waiting), strict=True)), dtype="int64")]
        if not state.hasTimedOut:
            for rows in batches:
                parts.append(rows[columns].astype("int64"))
                ends = int(rows["ends"].iloc[0]) if len(rows) else ends
        rows = pd.concat(parts, ignore_index=True).sort_values(["us", "event_id"], ignore_index=True)
        mark = max(0, state.getCurrentWatermarkMs())
        passed = int((rows["us"] <= mark * 1000).sum())
        ready, rest = rows[:passed], rows[passed:]
        before = total + ready["units"].cumsum() - ready["units"]
        total += int(ready["units"].sum())
        if len(rest) or ends > mark * 1000:
            state.update((total, ends, *(rest[c].tolist() for c in columns)))
            wake = int(rest["us"].iloc[0]) if len(rest) else ends
            state.setTimeoutTimestamp(max(mark + 1, wake // 1000))
        else:
            state.remove()
        yield pd.DataFrame({"event_id": ready["event_id"], "used_before": before.astype("int64"), "rejected": before >= ready["monthly_quota"]})

    held = "total long, ends long, us array<long>, event_id array<long>, units array<long>, monthly_quota array<long>"
    return own.groupBy("client_id", "period").applyInPandasWithState(decide, "event_id long, used_before long, rejected boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["add_usage", "event_stream", "meter", "metered", "outcome_counts", "quota_stream", "rate_windows", "throttled"]
