"""Directory trees from paths: directories, depth-first ranks, child counts, shape hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def items(files: DataFrame) -> DataFrame:
    """(path, name, type, depth, parent) of all files and the directories above them."""
    parts = F.split("file", "/")
    dirs = files.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))).alias("path")).distinct()
    both = files.select(F.col("file").alias("path"), F.lit("file").alias("type")).distinct().unionByName(dirs.withColumn("type", F.lit("directory")))
    depth = F.size(F.split("path", "/"))
    return both.select("path", F.substring_index("path", "/", -1).alias("name"), "type", depth.alias("depth"), F.regexp_replace("path", "/?[^/]*$", "").alias("parent"))


def ranked(files: DataFrame) -> DataFrame:
    """Adds dfs_rank: depth first, directories before files, names in binary order.

    The sort key is the array of (is last, is file, name) of the path's segments; the
    global rank of a vault's listing is one ordered window over it.
    """
    rows = items(files)
    parts = F.split("path", "/")
    key = F.transform(parts, lambda s, i: F.struct(((i == F.size(parts) - 1) & (F.col("type") == "file")).alias("f"), s.alias("n")))
    rows = rows.withColumn("_k", key)
    return rows.withColumn("dfs_rank", F.row_number().over(Window.orderBy("_k"))).drop("_k")


def children(files: DataFrame) -> DataFrame:
    """(parent, n_children) of every directory; the root is ''."""
    return items(files).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))


def tree_id(path):
    return F.concat(F.lit("t:"), F.substring(F.sha1(path.cast("binary")), 1, 14))
