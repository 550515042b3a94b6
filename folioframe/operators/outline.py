"""Outlines of heading rows (file, pos, level): structural paths, sections, token sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.scalars import stable_id


def parents(headings: DataFrame) -> DataFrame:
    """Adds parent_pos: the last earlier heading of a smaller level.

    For each level the last position seen so far is a running maximum, so the parent is
    the largest of them among smaller levels: one window, no self-join.
    """
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("pos"))).over(w) for n in range(1, 6)]
    above = [F.when(F.col("level") > n, last[n - 1]) for n in range(1, 6)]
    return headings.withColumn("parent_pos", F.greatest(*above))


def sibling_index(headings: DataFrame) -> DataFrame:
    """Adds sibling: the place among the parent's children of the same level, from 0."""
    w = Window.partitionBy("file", "parent_pos", "level").orderBy("pos")
    return parents(headings).withColumn("sibling", F.row_number().over(w) - 1)


def structural_paths(headings: DataFrame, max_depth: int = 6) -> DataFrame:
    """Adds structural_path and stable_id; at most six joins up the outline."""
    rows = sibling_index(headings).withColumn("slot", F.format_string("h%d[%d]", "level", "sibling"))
    up = rows.select(F.col("file").alias("_f"), F.col("pos").alias("_p"), F.col("slot").alias("_s"), F.col("parent_pos").alias("_pp"))
    out = rows.withColumn("structural_path", F.col("slot")).withColumn("_next", F.col("parent_pos"))
    for _ in range(max_depth - 1):
        out = out.join(up, (out["file"] == up["_f"]) & (out["_next"] == up["_p"]), "left")
        out = out.withColumn("structural_path", F.when(F.col("_s").isNotNull(), F.concat_ws("/", "_s", "structural_path")).otherwise(F.col("structural_path")))
        out = out.withColumn("_next", F.col("_pp")).drop("_f", "_p", "_s", "_pp")
    return out.drop("_next", "slot").withColumn("stable_id", stable_id(F.col("file"), F.col("structural_path")))


def section_ends(headings: DataFrame) -> DataFrame:
    """Adds section_end: position of the next heading of the same or a smaller level."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    next_of = [F.min(F.when(F.col("level") == n, F.col("pos"))).over(w) for n in range(1, 7)]
    return headings.withColumn("section_end", F.least(*[F.when(F.col("level") >= n, next_of[n - 1]) for n in range(1, 7)]))


def descendant_tokens(headings: DataFrame) -> DataFrame:
    """Adds descendant_tokens: own and all nested body tokens, by a running sum."""
    rows = section_ends(headings)
    w = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("_upto", F.sum("tokens").over(w))
    ends = rows.select(F.col("file").alias("_f"), F.col("pos").alias("_p"), (F.col("_upto") - F.col("tokens")).alias("_before"))
    total = F.sum("tokens").over(Window.partitionBy("file"))
    rows = rows.withColumn("_all", total).join(ends, (F.col("file") == F.col("_f")) & (F.col("section_end") == F.col("_p")), "left")
    return rows.withColumn("descendant_tokens", F.coalesce("_before", "_all") - F.col("_upto") + F.col("tokens")).drop("_f", "_p", "_before", "_all", "_upto")
