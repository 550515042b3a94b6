"""The vault's index: versioned snapshots of its tables behind a manifest.

A write makes the next version in a new folder and then replaces the manifest, so readers
see a whole version or the one before. Only changed files are parsed; their rows replace
the old ones, and headings that leave a file go to the history.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import diff, fulltext
from folioframe.parse import shred
from folioframe.sources.vault import read_vault

SHAPE_VERSION = 3
TABLES = ("files", "frontmatter", "tags", "fragments", "links", "blocks", "metrics")
HISTORY = "file string, stable_id string, heading_text string, heading_path array<string>, structural_path string, retired_at double"


class VaultIndex:
    def __init__(self, spark: SparkSession, vault: str, index: str, hidden: bool = False) -> None:
        self.spark, self.vault, self.dir, self.hidden = spark, vault, index.removeprefix("file://"), hidden
        os.makedirs(self.dir, exist_ok=True)

    # -- manifest -------------------------------------------------------------------------

    @property
    def manifest(self) -> dict:
        try:
            with open(os.path.join(self.dir, "manifest.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"state": "cold", "snapshot": 0, "folder": None, "shape": SHAPE_VERSION, "hidden": self.hidden}

    def _commit(self, folder: str) -> int:
        old = self.manifest
        new = {"state": "warm", "snapshot": max(old["snapshot"] + 1, int(time.time() * 1000)), "folder": folder, "shape": SHAPE_VERSION, "hidden": self.hidden}
        temporary = os.path.join(self.dir, f"manifest.{uuid.uuid4().hex}")
        with open(temporary, "w") as f:
            json.dump(new, f)
        os.replace(temporary, os.path.join(self.dir, "manifest.json"))
        return new["snapshot"]

    def valid(self) -> bool:
        """Whether the index was made under the present rules; else it is rebuilt."""
        m = self.manifest
        return bool(m["folder"]) and m["shape"] == SHAPE_VERSION and m["hidden"] == self.hidden

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest['folder']}/{name}")

    def fragments(self, folder: str | None = None) -> DataFrame:
        """The fragments with a key of their own, ``frag_id``."""
        rows = self.spark.read.parquet(f"{folder or self.manifest['folder']}/fragments")
        return rows.withColumn("frag_id", F.concat_ws("#", "file", F.col("pos").cast("string")))

    def postings(self) -> fulltext.Postings:
        """The snapshot's inverted index: folded, stemmed words of the fragments."""
        return fulltext.Postings(self.spark, f"{self.manifest['folder']}/search")

    def history(self) -> DataFrame:
        folder = self.manifest["folder"]
        return self.spark.read.schema(HISTORY).parquet(f"{folder}/history") if folder else self.spark.createDataFrame([], HISTORY)

    # -- writes ---------------------------------------------------------------------------

    def _write(self, tables: dict[str, DataFrame], history: DataFrame) -> int:
        folder = os.path.join(self.dir, f"v-{uuid.uuid4().hex}")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        history.select([c.split()[0] for c in HISTORY.split(", ")]).write.parquet(f"{folder}/history")
        fulltext.Postings.build(self.fragments(folder), f"{folder}/search", stem_words=True)
        return self._commit(folder)

    def refresh(self) -> int:
        """Bring the index up to the vault; returns the snapshot, unchanged if nothing was."""
        disk = read_vault(self.spark, self.vault, self.hidden)
        if not self.valid():
            return self._write(shred.tables(shred.shred(disk)), self.history())
        old = {name: self.table(name) for name in TABLES}
        changes = diff.reconcile(disk.select("file", "mtime", "size"), old["files"].select("file", "mtime", "size"))
        changes = self.spark.createDataFrame(changes.toArrow()) if changes.count() else changes
        if not changes.take(1):
            return self.manifest["snapshot"]
        redo = shred.shred(disk.join(changes.where("change <> 'removed'"), "file", "left_semi"))
        redo = redo.persist()
        new = shred.tables(redo)
        # A file that can't be parsed any more keeps the rows of its last good version.
        broken = redo.where("error is not null").select("file")
        gone = changes.select("file").join(broken, "file", "left_anti")
        result = {}
        for name, df in new.items():
            key = "source_file" if name == "links" else "file"
            before = old[name].join(gone.select(F.col("file").alias(key)), key, "left_anti")
            fresh = df if name != "files" else df.join(broken, "file", "left_anti")
            result[name] = before.select(fresh.columns).unionByName(fresh)
        heads = old["fragments"].where("stable_id is not null").join(gone, "file", "left_semi")
        left = diff.retired(heads, new["fragments"].where("stable_id is not null").select("file", "stable_id"))
        left = left.select("file", "stable_id", "heading_text", "heading_path", "structural_path", F.lit(time.time() * 1000).alias("retired_at"))
        history = diff.last_wins(self.history().unionByName(left), ["file", "stable_id"], "retired_at")
        try:
            return self._write(result, history)
        finally:
            redo.unpersist()
