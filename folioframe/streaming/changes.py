"""Keeps an index up to date from the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe.operators import diff
from folioframe.sources.index import VaultIndex
from folioframe.sources.vault import vault_changes


def latest(changes: DataFrame) -> DataFrame:
    """One change for each file of a batch: the last stat wins, removals over older ones."""
    order = F.coalesce("mtime", F.lit(float("inf")))
    return diff.last_wins(changes.withColumn("_at", order), ["file"], "_at").drop("_at")


def follow(index: VaultIndex, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream that refreshes the index for each batch of changes; refreshing is idempotent."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            index.refresh()

    writer = vault_changes(index.spark, index.vault).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="250 milliseconds")).start()
