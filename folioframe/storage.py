"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.shipping import ship

#: Files of a staged table at most, for each core: every file costs its writer a commit, and
#: tables of many small parts would be mostly commits.
FILES_PER_CORE = 8


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder if the driver is the only machine; an error else.
    """
    ship(spark)
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if found:
        if not current:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not current:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: staged tables need a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioframe-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def staged(df: DataFrame, name: str, per_core: int = FILES_PER_CORE) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in ``per_core`` files a core at most, and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and values that depend on task layout stay as they were committed.
    ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.coalesce(per_core * max(1, spark.sparkContext.defaultParallelism)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
