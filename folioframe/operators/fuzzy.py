"""Recovery of retired stable ids: candidates scored by text and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recover(retired: DataFrame, current: DataFrame, top: int = 3) -> DataFrame:
    """(file, stale_id, stable_id, score, has_text, rank): the best candidates of each stale id.

    1.0 for the same text, 0.5 for the same last slot, 0.25 times the shared prefix of the
    structural paths over the longer one, 0.1 if one is an ancestor of the other or equal.
    """
    r = retired.select("file", F.col("stable_id").alias("stale_id"), F.col("heading_text").alias("_t"), F.split("structural_path", "/").alias("_a"))
    c = current.select("file", "stable_id", "heading_text", "pos", F.split("structural_path", "/").alias("_b"))
    rows = r.join(c, "file")
    n = F.least(F.size("_a"), F.size("_b"))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("_a", i) == F.element_at("_b", i))
    shared = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(n)
    text = (F.col("_t") == F.col("heading_text")).cast("double")
    slot = (F.element_at("_a", -1) == F.element_at("_b", -1)).cast("double")
    line = (shared == n).cast("double")
    score = text + 0.5 * slot + 0.25 * shared / F.greatest(F.size("_a"), F.size("_b")) + 0.1 * line
    rows = rows.select("file", "stale_id", "stable_id", "pos", (text > 0).alias("has_text"), (F.floor(score * 1000 + 0.5) / 1000).alias("score"))
    w = Window.partitionBy("file", "stale_id").orderBy(F.col("has_text").desc(), F.col("score").desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("pos")
