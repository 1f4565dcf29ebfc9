"""Publication as a whole: versions behind a pointer, and update cycles with their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from addrflow.operators import publish
from addrflow.operators.cycle import Cycle, publish_state
from addrflow.sources import store
from addrflow.sources.scratch import scratch_folder

from .register import AS_OF, query

REGIONS = ["00", "01", "02"]
#: What published and staged points derive from: a cycle reads them a dozen times.
KEEP = ("locality", "street", "point")
LOOSE = {"min_rows": 1, "max_delta": 0.5, "commune_drop": 1.0}


def _street(street):
    return street.withColumn("source", F.lit("official"))


@query(
    "publish_state",
    "published",
    "staged",
    "locality",
    "street",
    sql="""
WITH s AS (SELECT *, CASE WHEN street_id IS NOT NULL AND k % 2 = 0 THEN simc || '-' || lpad(substring(street_id, 13, 1), 5, '0') WHEN street_id IS NOT NULL THEN street_id END AS linked FROM staged WHERE region IN ('00', '01', '02')),
m AS (SELECT coalesce(s.point_id, c.point_id) AS point_id, coalesce(s.simc, c.simc) AS simc, CASE WHEN s.point_id IS NULL OR (c.withdrawn IS NULL AND c.hash = s.hash) THEN c.street_id ELSE s.linked END AS street_id,
  CASE WHEN s.point_id IS NOT NULL THEN NULL WHEN c.withdrawn IS NULL AND c.region IN ('00', '01', '02') THEN 'now' WHEN c.withdrawn IS NOT NULL THEN 'before' END AS gone FROM published c FULL OUTER JOIN s ON c.point_id = s.point_id)
SELECT 'point' AS kind, count(*) AS n, count(gone) AS withdrawn, count(street_id) AS linked FROM m UNION ALL SELECT 'street', count(*), 0, count(*) FILTER (n > 0) FROM (SELECT st.street_id, count(m.point_id) AS n FROM street st LEFT JOIN m ON st.street_id = m.street_id AND m.gone IS NULL GROUP BY 1)
UNION ALL SELECT 'locality', count(*), 0, count(*) FILTER (n > 0) FROM (SELECT l.simc, count(m.point_id) AS n FROM locality l LEFT JOIN m ON l.simc = m.simc AND m.gone IS NULL GROUP BY 1)""",
    keep=KEEP,
)
def _(published, staged, locality, street):
    """Everything between staging and pointer: references, merges, links, withdrawals, counts."""
    digit, code = F.substring("street_id", 13, 1), F.col("simc").cast("bigint").cast("string")
    ref = F.when(F.col("street_id").isNotNull(), F.when(F.col("k") % 2 == 0, F.concat(F.lit("U-"), code, F.lit("-"), digit)).otherwise(digit))
    points = staged.where(F.col("region").isin(*REGIONS)).withColumn("locality_ref", F.concat(F.lit("M-"), code)).withColumn("street_ref", ref)
    roads = _street(street).withColumn("locality_ref", F.concat(F.lit("M-"), code))
    tables, _ = publish_state({"point": published, "locality": locality, "street": street}, {"point": points, "locality": locality, "street": roads}, AS_OF, REGIONS)
    none = F.lit(0).cast("long").alias("withdrawn")
    a = tables["point"].agg(F.count("*").alias("n"), F.count("withdrawn").alias("withdrawn"), F.count("street_id").alias("linked")).select(F.lit("point").alias("kind"), "n", "withdrawn", "linked")
    parts = [tables[t].agg(F.count("*").alias("n"), F.count_if(F.col("n_points") > 0).alias("linked")).select(F.lit(t).alias("kind"), "n", none, "linked") for t in ("street", "locality")]
    return a.unionByName(parts[0]).unionByName(parts[1])


@query(
    "update_cycles",
    "published",
    "staged",
    "locality",
    "street",
    sql="""
WITH f AS (SELECT coalesce(n.point_id, c.point_id) AS point_id, c.point_id AS old, n.point_id AS new, c.withdrawn, c.hash AS h, n.hash AS g FROM published c FULL OUTER JOIN staged n ON c.point_id = n.point_id)
SELECT '1' AS version, 'published' AS outcome, '' AS reason, count(*) AS added, 0 AS changed, 0 AS restored, 0 AS withdrawn, 0 AS unchanged FROM published
UNION ALL SELECT '2', 'no_change', '', -1, -1, -1, -1, -1 UNION ALL SELECT '3', 'held', 'delta_size', -1, -1, -1, -1, -1 UNION ALL SELECT '4', 'error', 'some', -1, -1, -1, -1, -1
UNION ALL SELECT '5', 'published', '', count(*) FILTER (old IS NULL), count(*) FILTER (old IS NOT NULL AND new IS NOT NULL AND h <> g), 0, count(*) FILTER (new IS NULL), count(*) FILTER (old IS NOT NULL AND h = g) FROM f
UNION ALL SELECT '5', 'error', 'some', -1, -1, -1, -1, -1 UNION ALL SELECT '6', 'published', '', 0, 0, 0, 0, count(*) FROM staged""",
    keep=KEEP,
)
def _(published, staged, locality, street):
    """First publication, nothing new, a shrunken snapshot, a broken one, a new one, a version that exists, the same again."""
    spark = published.sparkSession
    cycle = Cycle(spark, scratch_folder(spark, "cycles"), LOOSE)
    regions = [r["region"] for r in staged.select("region").union(published.select("region")).distinct().collect()]
    tables = lambda points: lambda: {"point": points, "locality": locality, "street": _street(street)}
    # The snapshot before had the published points, whether withdrawn since or not.
    before = published.withColumn("withdrawn", F.lit(None).cast("timestamp"))
    cycle.run("1", tables(before), regions, AS_OF)
    cycle.run("2", tables(staged), [], AS_OF)
    cycle.run("3", tables(staged.where("k % 3 = 0")), regions, AS_OF)
    cycle.run("4", tables(staged.drop("hash")), regions, AS_OF)
    cycle.run("5", tables(staged), regions, AS_OF)
    cycle.run("5", tables(staged), regions, AS_OF)
    cycle.run("6", tables(staged), regions, AS_OF)
    counts = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("added", "changed", "restored", "withdrawn", "unchanged")]
    return cycle.runs().select("version", "outcome", F.when(F.col("outcome") == "error", "some").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"), *counts)


@query(
    "changed_parts",
    "published",
    "locality",
    "street",
    sql="""
WITH p AS (SELECT DISTINCT region, substring(md5(point_id), 1, 1) AS b FROM published), o AS (SELECT DISTINCT 's', substring(md5(street_id), 1, 1) FROM street UNION ALL SELECT DISTINCT 'l', substring(md5(simc), 1, 1) FROM locality),
n AS (SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM p WHERE region = '01' AND b IN ('0', '1')) AS moved)
SELECT '1' AS version, 0 AS parts_kept, total AS parts_written FROM n UNION ALL SELECT '2', total - moved, moved FROM n UNION ALL SELECT '3', total, 0 FROM n""",
    keep=KEEP,
)
def _(published, locality, street):
    """Parts that stay the files they are: none at first, all but those with a changed point, all without a change."""
    spark = published.sparkSession
    cycle = Cycle(spark, scratch_folder(spark, "parts"), LOOSE)
    tables = lambda points: lambda: {"point": points, "locality": locality, "street": _street(street)}
    before = published.withColumn("withdrawn", F.lit(None).cast("timestamp"))
    moved = (F.col("region") == "01") & F.substring(F.md5("point_id"), 1, 1).isin("0", "1")
    after = before.withColumn("hash", F.when(moved, F.concat("hash", F.lit("|new"))).otherwise(F.col("hash")))
    regions = [r["region"] for r in published.select("region").distinct().collect()]
    cycle.run("1", tables(before), regions, AS_OF)
    cycle.run("2", tables(after), ["01"], AS_OF)
    cycle.run("3", tables(after), regions, AS_OF)
    return cycle.runs().select("version", "parts_kept", "parts_written")


@query(
    "duplicate_points",
    "published",
    "staged",
    sql="SELECT (SELECT count(*) FROM staged WHERE k % 7 = 0) AS ids, (SELECT count(*) FROM staged WHERE k % 7 = 0) AS surplus, count(*) AS rows, 0 AS stale FROM published c FULL OUTER JOIN staged n ON c.point_id = n.point_id",
)
def _(published, staged):
    """A snapshot that has every seventh point twice: the later version is published, once."""
    rows = staged.withColumn("version_id", F.lit("2024-02-01T10:00"))
    old = staged.where("k % 7 = 0").withColumn("version_id", F.lit("2023-05-01T10:00")).withColumn("hash", F.lit("stale"))
    both = rows.unionByName(old)
    merged = publish.merge_points(published, both, AS_OF).agg(F.count("*").alias("rows"), F.count_if(F.col("hash") == "stale").alias("stale"))
    return publish.duplicate_ids(both).join(merged, F.lit(True)).select("ids", "surplus", "rows", "stale")


@query("published_versions", "published", "staged", sql="SELECT 'current' AS what, '11' AS version, count(*) AS rows FROM staged UNION ALL SELECT 'pruned', '8', 0 UNION ALL SELECT 'pruned', '9', 0 UNION ALL SELECT 'moved', '11', 1 UNION ALL SELECT 'unmoved', '11', 0")
def _(published, staged):
    """Four versions behind a pointer; the two oldest are pruned though their names sort last."""
    spark = published.sparkSession
    root = scratch_folder(spark, "versions")
    for version, df in (("8", published), ("9", staged), ("10", published), ("11", staged)):
        store.publish_version({"point": df.select("point_id", "region", "hash")}, root, version)
    gone = store.prune_versions(spark, root, 2)
    seen, found = store.reload_if_moved(spark, root, "8", ["point"])
    again, none = store.reload_if_moved(spark, root, seen, ["point"])
    rows = [("pruned", v, 0) for v in gone] + [("moved", seen, len(found)), ("unmoved", again, len(none))]
    current = store.read_current(spark, root, "point").agg(F.count("*").alias("rows")).select(F.lit("current").alias("what"), F.lit(seen).alias("version"), "rows")
    return current.unionByName(spark.createDataFrame(rows, "what string, version string, rows long"))


@query("staged_regions", "staged", sql="SELECT region, count(*) AS n, count(*) FILTER (region IN ('01')) AS replaced FROM staged WHERE region NOT IN ('01') OR k % 2 = 0 GROUP BY 1")
def _(staged):
    """A staging table in which one region is replaced."""
    root = scratch_folder(staged.sparkSession, "staging")
    rows = staged.select("point_id", "k", "region")
    store.write_staging(rows.withColumn("replaced", F.lit(False)), root)
    store.write_staging(rows.where("region = '01' AND k % 2 = 0").withColumn("replaced", F.lit(True)), root, "append")
    back = staged.sparkSession.read.schema("point_id string, k long, replaced boolean, region string").parquet(root)
    return back.groupBy("region").agg(F.count("*").alias("n"), F.count_if("replaced").alias("replaced"))


@query("archived_sources", "secondary", sql="SELECT 'a' AS source, 'v2' AS version, count(*) AS n FROM secondary WHERE postal_code IS NOT NULL")
def _(secondary):
    """A comparison source is replaced by version; one version is read back."""
    spark, root = secondary.sparkSession, scratch_folder(secondary.sparkSession, "archive")
    rows = secondary.select("id", "postal_code")
    for source, version, df in (("a", "v1", rows), ("a", "v2", rows), ("b", "v1", rows), ("a", "v2", rows.where("postal_code IS NOT NULL"))):
        store.write_comparison(df.withColumn("source", F.lit(source)).withColumn("source_version", F.lit(version)), root)
    back = store.read_archive(spark, root, "a", "v2", "source_version")
    return back.groupBy("source", F.col("source_version").alias("version")).agg(F.count("*").alias("n"))


@query("snapshot_changes", "published", "staged", sql="WITH a AS (SELECT region, sum(k) AS s FROM published GROUP BY 1), b AS (SELECT CASE region WHEN '04' THEN '05' ELSE region END AS region, sum(k) AS s FROM staged WHERE region <> '03' GROUP BY 1), same AS (SELECT '00' AS region) SELECT coalesce(a.region, b.region) || '.gml' AS file, CASE WHEN a.region IS NULL THEN 'added' WHEN b.region IS NULL THEN 'removed' WHEN a.region = '00' THEN 'same' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.region = b.region")
def _(published, staged):
    """Files of two snapshots by checksum: one new, one gone, one the same, the others changed."""
    spark, root = published.sparkSession, scratch_folder(published.sparkSession, "snapshots")
    name = F.when(F.col("region") == "04", "05").otherwise(F.col("region"))
    new = staged.where("region NOT IN ('00', '03')").withColumn("region", name).unionByName(published.where("region = '00'"), allowMissingColumns=True)
    for folder, df in (("old", published), ("new", new)):
        parts = df.groupBy("region").agg(F.sum("k").cast("string").alias("value"))
        parts.repartition(1).write.partitionBy("region").text(f"{root}/{folder}")
    manifests = [store.snapshot_manifest(spark, f"{root}/{f}/region=*/*.txt", F.concat(F.regexp_extract("path", "region=([0-9]+)", 1), F.lit(".gml"))) for f in ("old", "new")]
    return store.changed_files(*manifests)


@query("picked_members", "nation", sql="SELECT lpad(cast(n_regionkey AS string), 2, '0') AS region, 'NOWE_' || cast(max(n_nationkey) AS string) || '.gml' AS file FROM nation WHERE n_nationkey % 2 = 1 GROUP BY 1")
def _(nation):
    """Of a region's files one: of the new structure, the largest of them."""
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 1, "NOWE_").otherwise(""), F.col("n_nationkey").cast("string"), F.lit(".gml"))
    files = nation.select(F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("region"), name.alias("file"), (F.col("n_nationkey") % 2 * -1000 + F.col("n_nationkey")).alias("size"))
    return store.pick_members(files).select("region", "file")


@query("uncoded_streets", "street", "locality", sql="WITH cur AS (SELECT * FROM street WHERE sym_ul IN ('00001', '00002')), st AS (SELECT simc, name_norm, max(kind) AS kind FROM street WHERE sym_ul IN ('00002', '00003', '00004') GROUP BY 1, 2) SELECT street_id FROM cur UNION ALL SELECT simc || '-x-' || name_norm || '-' || kind FROM st WHERE (simc, name_norm) NOT IN (SELECT simc, name_norm FROM cur)")
def _(street, locality):
    """Streets without a code join the catalogue unless one with a code has their name; each comes twice."""
    current = street.where("sym_ul IN ('00001', '00002')").select("street_id", "simc", "sym_ul", "kind", "name", "name_norm", "withdrawn")
    own = street.where("sym_ul IN ('00002', '00003', '00004')").withColumn("sym_ul", F.lit(None).cast("string"))
    return publish.merge_uncoded_streets(current, own.unionByName(own.withColumn("gml_id", F.concat("gml_id", F.lit("b")))), locality).select("street_id")


@query("moved_kinds", "street", sql="SELECT street_id, CASE WHEN sym_ul = '00001' THEN 'rondo' WHEN sym_ul = '00002' THEN 'al.' ELSE kind END AS kind, name, name_norm FROM street")
def _(street):
    """A kind word at the start of a name moves to the kind, which stays if there was one."""
    word = F.when(F.col("sym_ul") == "00001", "Rondo ").when(F.col("sym_ul") == "00002", "ulica ").otherwise("")
    rows = street.withColumn("name", F.concat(word, "name")).withColumn("kind", F.when(F.col("sym_ul") != "00001", F.col("kind")))
    return publish.split_type_words(rows).select("street_id", "kind", "name", "name_norm")
