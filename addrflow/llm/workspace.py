"""Shared scratch tables: intermediate results that every executor can read again after a loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that a task is given at a time, where the session has Spark's own bound.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session on one machine (``local[...]``, as in tests) gets a folder of its own; a cluster must
    name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="addrflow-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to tasks in Arrow batches: bound them by bytes, unless the session already does."""
    if int(spark.conf.get(_BATCH_CONF, str(_BATCH_DEFAULT)).rstrip("b")) >= _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
