"""Set differences between snapshots: incremental indexing, retirement, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(file, change): new, drift or removed; rows that agree are left out."""
    both = disk.alias("d").join(index.alias("i"), F.col("d.file") == F.col("i.file"), "full")
    drift = ~F.col("d.mtime").eqNullSafe(F.col("i.mtime")) | F.col("i.size").isNull() | ~F.col("d.size").eqNullSafe(F.col("i.size"))
    change = F.when(F.col("i.file").isNull(), "new").when(F.col("d.file").isNull(), "removed").when(drift, "drift")
    return both.select(F.coalesce("d.file", "i.file").alias("file"), change.alias("change")).where("change is not null")


def retired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Headings whose stable id left its file."""
    return old.join(new, ["file", "stable_id"], "left_anti")


def vanished(index: DataFrame, disk: DataFrame, failed: DataFrame) -> DataFrame:
    """Indexed files that are gone, without those under a subtree that couldn't be read.

    ``failed`` (prefix) is joined on every directory above a file: an equality join.
    """
    gone = index.join(disk, "file", "left_anti")
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = gone.select("file", F.explode(above).alias("prefix")).join(failed, "prefix", "left_semi").select("file").distinct()
    return gone.join(under, "file", "left_anti")


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot of a table: rows of changed files come from ``new``."""
    return old.join(changed.select("file").distinct(), "file", "left_anti").unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
