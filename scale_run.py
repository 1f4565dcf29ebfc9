"""A registry of any size through load, gates, publication and search: times each step, prints one JSON line.

    python scale_run.py POINTS [CPUS]"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from addrflow.operators import search
from addrflow.operators.cycle import Cycle
from addrflow.sources import datagen

AS_OF = "2024-02-01 00:00:00"
LOOSE = {"min_rows": 1, "commune_drop": 1.0}


def scale_run(spark: SparkSession, n: int, root: str, asked: int = 10_000) -> list[dict]:
    """Steps with seconds and figures: load, first publication, no change, a change of 0.4 %, index, suggestions."""
    steps: list[dict] = []

    def step(name: str, run) -> object:
        start = time.time()
        out = run()
        steps.append({"step": name, "seconds": round(time.time() - start, 2)} | (out if isinstance(out, dict) else {}))
        return out

    tables = datagen.registry(spark, n)
    staged = {t: f"{root}/staged/{t}" for t in tables}

    def load() -> dict:
        for t, df in tables.items():
            df.write.parquet(staged[t])
        return {"points": spark.read.parquet(staged["point"]).count()}

    step("load", load)
    read = {t: spark.read.parquet(p) for t, p in staged.items()}
    regions = sorted(r["region"] for r in read["point"].select("region").distinct().collect())
    cycle = Cycle(spark, f"{root}/published", LOOSE, digits=2 if n > 1_000_000 else 1)

    def publish(version: str, points, changed: list[str]):
        def run() -> dict:
            cycle.run(version, lambda: {"point": points, "locality": read["locality"], "street": read["street"]}, changed, AS_OF)
            row = cycle.runs().where(F.col("version") == version).first()
            return {k: row[k] for k in ("outcome", "reason", "added", "changed", "unchanged", "parts_kept", "parts_written")}

        return run

    step("first publication", publish("1", read["point"], regions))
    step("the same again", publish("2", read["point"], regions))
    one = regions[:1]
    # 0.4 % of all points, in the one region whose file changed.
    share = 0.004 * n / max(1, read["point"].where(F.col("region").isin(one)).count())
    moved = F.col("region").isin(one) & (datagen.unit(F.col("point_id"), "moved") < share)
    changed = read["point"].withColumn("hash", F.when(moved, F.lit("moved")).otherwise(F.col("hash")))
    step("0.4 % changed", publish("3", changed, one))
    state = cycle.state()
    docs = search.build_docs(state["locality"], state["street"], read["unit"])
    made = {}

    def index() -> dict:
        made["index"] = search.build_index(docs)
        return {"documents": made["index"].docs.count(), "keys": made["index"].entries.count()}

    step("index", index)
    label = F.regexp_replace(F.regexp_replace("label", "^ul. ", ""), ",.*", "")
    picked = made["index"].docs.orderBy(F.xxhash64("doc_id")).limit(asked).withColumn("n", F.pmod(F.xxhash64("doc_id", F.lit("n")), F.lit(3)))
    queries = picked.select(F.col("doc_id").alias("query_id"), F.when(F.col("n") == 0, F.substring(label, 1, 3)).when(F.col("n") == 1, F.substring(label, 1, 7)).otherwise(label).alias("q"))
    queries.write.parquet(f"{root}/queries")

    def suggest() -> dict:
        return {"hits": search.suggest(spark.read.parquet(f"{root}/queries"), made["index"], 10).count(), "queries": asked}

    step("suggestions", suggest)
    return steps


def main() -> None:
    n, cpus = int(sys.argv[1]), sys.argv[2] if len(sys.argv) > 2 else os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="spark-scale-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "32").config("spark.local.dir", f"{work}/local").config("spark.checkpoint.dir", f"{work}/checkpoints").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    steps = scale_run(spark, n, work)
    spark.stop()
    print(json.dumps({"points": n, "steps": steps}))


if __name__ == "__main__":
    main()
