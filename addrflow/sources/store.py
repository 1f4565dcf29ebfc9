"""Snapshot manifests, staging tables, and versioned publication in parts behind a pointer."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of a file that are hashed at a time.
BLOCK = 64 << 20


def _block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, digest) of ranges of files, read in pieces of a megabyte."""
    for batch in batches:
        digests = []
        for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True):
            system, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_file(place) as f:
                for at in range(start, start + size, 1 << 20):
                    digest.update(f.read_at(min(1 << 20, start + size - at), at))
            digests.append(digest.digest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(digests, pa.binary())], ["path", "start", "digest"])


def snapshot_manifest(spark: SparkSession, glob: str, name: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(file, size, sha256) of the files of a snapshot; ``name`` gives the file's name from its ``path``.

    The checksum is the SHA-256 of the SHA-256 digests of the file's blocks, in their order, so that a file of any size is
    hashed by many tasks.  Files of one block are read by Spark; larger ones by ranges, which needs a scheme that Arrow opens
    (local and shared folders, HDFS, object stores).  An empty file is no file of a snapshot: Spark lists none."""
    files = spark.read.format("binaryFile").load(glob)
    own = F.element_at(F.split("path", "/"), -1) if name is None else name
    small = files.where(F.col("length") <= block).select("path", F.col("length").alias("size"), F.sha2(F.unhex(F.sha2("content", 256)), 256).alias("sha256"))
    # Without its content a file's row is its name and size.
    large = files.select("path", F.col("length").alias("bytes")).where(F.col("bytes") > block)
    ranges = large.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block).cast("long"))).alias("start"))
    ranges = ranges.withColumn("size", F.least(F.lit(block), F.col("bytes") - F.col("start")))
    hashed = ranges.repartition("path", "start").mapInArrow(_block_hashes, "path string, start long, digest binary")
    whole = hashed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("blocks")).join(large, "path")
    joined = F.aggregate("blocks", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
    rows = small.unionByName(whole.select("path", F.col("bytes").alias("size"), F.sha2(joined, 256).alias("sha256")))
    return rows.select(own.alias("file"), "size", "sha256")


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file, change): added, removed, changed or same, by checksum."""
    a = previous.select("file", F.col("sha256").alias("old"))
    b = current.select("file", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", change.alias("change"))


def pick_members(manifest: DataFrame, prefer_new: bool = True) -> DataFrame:
    """One file for each region: of the new structure if preferred, then the largest."""
    new = F.upper("file").startswith("NOWE_")
    first = F.when(new, 0).otherwise(1) if prefer_new else F.when(new, 1).otherwise(0)
    w = Window.partitionBy("region").orderBy(first, F.desc("size"), "file")
    return manifest.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_staging(df: DataFrame, root: str, mode: str = "replace", region: str = "region") -> None:
    """Replace a staging table, or only the regions that ``df`` holds."""
    writer = df.write.partitionBy(region)
    if mode == "replace":
        writer.mode("overwrite").parquet(root)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def write_comparison(df: DataFrame, root: str) -> None:
    """Replace the rows of the (source, version) pairs that ``df`` holds."""
    df.write.partitionBy("source", "source_version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_archive(spark: SparkSession, root: str, source: str, version: str, column: str = "version") -> DataFrame:
    """An archived snapshot, by partition."""
    return spark.read.option("basePath", root).parquet(root).where((F.col("source") == source) & (F.col(column) == version))


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


#: What a version is: each table's parts, where they are, and what tells whether they have changed.
MANIFEST = "table string, part string, path string, rows long, digest decimal(38,0), schema string"


def hashed_part(key: str, digits: int = 1, within: str | None = None) -> Column:
    """The part of a row: the first hex digits of its key's md5, within a column (such as the region) if given.

    A part is read and written as a whole: 16 ** ``digits`` of them should leave some 100 MB in each.  Rows without a key or
    within nothing have a part of their own."""
    bucket = F.coalesce(F.substring(F.md5(F.col(key)), 1, digits), F.lit("none"))
    return bucket if within is None else F.concat_ws("-", F.coalesce(F.col(within), F.lit("none")), bucket)


def _digests(df: DataFrame) -> DataFrame:
    """(part, rows, digest): the digest is a sum of row hashes, so neither order nor files matter."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if c != "part"), *(F.col(f"`{c}`").isNull() for c in df.columns if c != "part"))
    return df.groupBy("part").agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def check_unpublished(spark: SparkSession, root: str, version: str) -> None:
    """An error if the version was published."""
    fs, hadoop = _fs(spark, root)
    if fs.exists(hadoop.Path(f"{root}/v={version}/_complete")):
        raise ValueError(f"version {version} is published already")


def publish_version(tables: dict[str, DataFrame], root: str, version: str, parts: dict[str, Column] | None = None, within: dict[str, Collection[str]] | None = None) -> dict[str, tuple[int, int]]:
    """Publish a version and then move the pointer: readers see all of it or nothing.

    ``parts`` divides a table (one part without).  A version is a manifest of parts: those whose rows differ from the current
    version's are written, all others stay the files they were, so what is written follows what has changed.  ``within``
    says that a table holds only the parts that begin with one of these names; the other ones stay.  A version that was
    published is never written again, as readers may hold it; what a failed attempt left is replaced.  The pointer is renamed
    over the old one in one step.  Returns (parts kept, parts written) by table."""
    spark = next(iter(tables.values())).sparkSession
    check_unpublished(spark, root, version)
    fs, hadoop = _fs(spark, root)
    done = hadoop.Path(f"{root}/v={version}/_complete")
    before = current_version(spark, root)
    old = {(r["table"], r["part"]): r for r in read_manifest(spark, root, before).collect()} if before else {}
    lines, counts = [], {}
    for name, df in tables.items():
        schema = df.schema.json()
        held = df.withColumn("part", (parts or {}).get(name, F.lit("all")))
        scope = tuple(f"{w}-" for w in (within or {})[name]) if within and name in within else None
        stays = [r for (t, p), r in old.items() if t == name and scope is not None and not p.startswith(scope)]
        # As many rows as there are parts.
        new = _digests(held).collect()
        same = {d["part"]: r for d in new if (r := old.get((name, d["part"]))) and (r["rows"], r["digest"], r["schema"]) == (d["rows"], d["digest"], schema)}
        changed = [d for d in new if d["part"] not in same]
        target = f"data/{name}/{version}-{uuid.uuid4().hex}"
        if changed:
            wanted = F.broadcast(spark.createDataFrame([(d["part"],) for d in changed], "part string"))
            rows = held.join(wanted, "part")
            rows = rows.repartition("part") if parts and name in parts else rows
            rows.write.partitionBy("part").parquet(f"{root}/{target}")
        lines += [(name, r["part"], r["path"], r["rows"], r["digest"], schema) for r in [*stays, *same.values()]]
        lines += [(name, d["part"], f"{target}/part={d['part']}", d["rows"], d["digest"], schema) for d in changed]
        if not (stays or new):
            lines.append((name, None, None, 0, None, schema))
        counts[name] = (len(stays) + len(same), len(changed))
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/v={version}/_manifest")
    fs.create(done, True).close()
    fresh, pointer = hadoop.Path(f"{root}/_pointer.new"), hadoop.Path(f"{root}/_pointer")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, overwrite)
    return counts


def read_manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The parts of a version."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/v={version}/_manifest")


def read_version(spark: SparkSession, root: str, version: str, table: str, within: Collection[str] | None = None) -> DataFrame:
    """A table of a version, or only its parts that begin with one of these names: other files are not even listed."""
    lines = read_manifest(spark, root, version).where(F.col("table") == table).collect()
    if not lines:
        raise ValueError(f"version {version} has no table {table}")
    scope = None if within is None else tuple(f"{w}-" for w in within)
    paths = [f"{root}/{r['path']}" for r in lines if r["path"] and (scope is None or r["part"].startswith(scope))]
    schema = StructType.fromJson(json.loads(lines[0]["schema"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names."""
    fs, hadoop = _fs(spark, root)
    pointer = hadoop.Path(f"{root}/_pointer")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def read_current(spark: SparkSession, root: str, table: str, within: Collection[str] | None = None) -> DataFrame:
    """A table of the current version."""
    return read_version(spark, root, current_version(spark, root), table, within)


def reload_if_moved(spark: SparkSession, root: str, seen: str | None, tables: list[str]) -> tuple[str | None, dict[str, DataFrame]]:
    """(version, its tables) if the pointer has moved from ``seen``, else (seen, nothing)."""
    version = current_version(spark, root)
    if version is None or version == seen:
        return seen, {}
    return version, {t: read_version(spark, root, version, t) for t in tables}


def prune_versions(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Delete all versions but the ``keep`` written last and the current one, and all parts that no other version names;
    returns what went, the oldest first (S20).  No version may be in the making meanwhile."""
    fs, hadoop = _fs(spark, root)
    found = [s.getPath() for s in fs.listStatus(hadoop.Path(root)) if s.getPath().getName().startswith("v=")]

    def written(path) -> tuple:
        # An attempt without its mark failed: it goes first.
        mark = hadoop.Path(path, "_complete")
        return (fs.exists(mark), fs.getFileStatus(mark if fs.exists(mark) else path).getModificationTime(), path.getName())

    have = [p.getName()[2:] for p in sorted(found, key=written)]
    stay = {*have[len(have) - keep :], current_version(spark, root)}
    gone = [v for v in have if v not in stay]
    for v in gone:
        fs.delete(hadoop.Path(f"{root}/v={v}"), True)
    named = {r["path"] for v in have if v in stay and fs.exists(hadoop.Path(f"{root}/v={v}/_manifest")) for r in read_manifest(spark, root, v).select("path").distinct().collect()}
    folders = {p.rsplit("/", 1)[0] for p in named if p}
    for table in fs.listStatus(hadoop.Path(f"{root}/data")) if fs.exists(hadoop.Path(f"{root}/data")) else []:
        for attempt in fs.listStatus(table.getPath()):
            place = f"data/{table.getPath().getName()}/{attempt.getPath().getName()}"
            if place not in folders:
                fs.delete(attempt.getPath(), True)
                continue
            for part in fs.listStatus(attempt.getPath()):
                if part.isDirectory() and f"{place}/{part.getPath().getName()}" not in named:
                    fs.delete(part.getPath(), True)
    return gone
