"""Every trusted document counts, however many there are."""

from pyspark.sql import functions as F

from addrflow.llm import quality_rules as q


def test_all_trusted_ids_are_dealt_and_counted(spark):
    """More ids than the 20,000 that once were the most; repeated and null ones count once or not."""
    ids = spark.range(25_000).selectExpr("id AS doc_id").unionByName(spark.createDataFrame([(3,), (None,)], "doc_id long"))
    halves = q._halves(ids, "doc_id")
    assert halves.count() == 25_000 and halves.select("_half").distinct().count() == 2
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    seen = q.ratio_table(docs, halves, "doc_id", "text", 16).first()
    n = {r["_half"]: r["count"] for r in halves.groupBy("_half").count().collect()}
    bucket = docs.limit(1).select(F.pmod(F.xxhash64("text"), F.lit(16))).first()[0]
    want = lambda t: __import__("math").log1p(t * (25_000 + 16) / (q.PRIOR * 25_001))
    assert abs(seen["first"][bucket] - want(n[0])) < 1e-12 and abs(seen["second"][bucket] - want(n[1])) < 1e-12
