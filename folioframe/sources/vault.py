"""A folder of notes as a Spark data source (``vault``), batch and streaming.

Each folder is a partition of the read, so listing a large tree and reading its files runs on
the executors. Hidden names, symbolic links, files of other types, paths that break the
path rules and names that aren't NFC are left out. Spark's own ``binaryFile`` also hides
names with a leading underscore and reports neither deletions nor edits, so it isn't used.
The folder must be reachable as a path on all executors.
"""

from __future__ import annotations

import os
import re
import unicodedata

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

EXTENSIONS = ("md", "markdown", "yaml", "yml", "prisma")
MAX_BYTES = 10 * 1024 * 1024
SCHEMA = "file string, content binary, mtime double, size long, error string"
CHANGES = "file string, change string, mtime double, size long"


def policy(rel: str) -> str | None:
    """The first broken path rule."""
    parts = rel.split("/")
    rules = (
        ("EMPTY", not rel.strip()), ("TOO_LONG", len(rel) > 1024), ("NUL_BYTE", "\0" in rel), ("CONTROL_CHAR", re.search(r"[\x01-\x1f\x7f]", rel)),
        ("PERCENT_ENCODED", re.search("%[0-9A-Fa-f]{2}", rel)), ("BACKSLASH", "\\" in rel), ("ABSOLUTE", rel.startswith("/")),
        ("DOT_SEGMENT", {".", ".."} & set(parts)), ("TOO_DEEP", len(parts) > 32),
    )
    return next((name for name, broken in rules if broken), None)


def listing(root: str, rel: str = "", hidden: bool = False, assets: bool = False, deep: bool = True):
    """(relative path, mtime in ms, size) below a folder; unreadable folders are yielded with None."""
    try:
        entries = sorted(os.scandir(os.path.join(root, rel) if rel else root), key=lambda e: e.name)
    except OSError:
        yield rel, None, None
        return
    for e in entries:
        path = f"{rel}/{e.name}" if rel else e.name
        if e.is_symlink() or (e.name.startswith(".") and not hidden) or unicodedata.normalize("NFC", e.name) != e.name or policy(path):
            continue
        if e.is_dir(follow_symlinks=False):
            if deep:
                yield from listing(root, path, hidden, assets)
        elif e.is_file(follow_symlinks=False) and (assets or e.name.rsplit(".", 1)[-1].lower() in EXTENSIONS):
            st = e.stat(follow_symlinks=False)
            yield path, st.st_mtime_ns / 1e6, st.st_size


class Folder(InputPartition):
    def __init__(self, rel: str) -> None:
        self.rel = rel


class VaultReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].removeprefix("file://")
        self.hidden = options.get("hidden", "false") == "true"

    def partitions(self):
        out = [""]
        for base, dirs, _ in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if (self.hidden or not d.startswith(".")) and not os.path.islink(os.path.join(base, d)))
            out += [os.path.relpath(os.path.join(base, d), self.root).replace(os.sep, "/") for d in dirs]
        return [Folder(d) for d in out]

    def read(self, partition):
        for path, mtime, size in listing(self.root, partition.rel, self.hidden, deep=False):
            if mtime is None:
                continue
            if size > MAX_BYTES:
                yield path, None, mtime, size, "too_large"
                continue
            try:
                fd = os.open(os.path.join(self.root, path), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
                with os.fdopen(fd, "rb") as f:
                    yield path, f.read(), mtime, size, None
            except OSError:
                yield path, None, mtime, size, "unreadable"


class VaultChanges(SimpleDataSourceStreamReader):
    """A feed of new, changed and removed files: offsets are listings."""

    def __init__(self, options) -> None:
        self.root = options["path"].removeprefix("file://")

    def initialOffset(self):
        return {"files": {}}

    def _between(self, start, end):
        old, new = start["files"], end["files"]
        for f in sorted({*old, *new}):
            if f not in new:
                yield f, "unlink", None, None
            elif old.get(f) != new[f]:
                yield f, "add" if f not in old else "change", float(new[f][0]), int(new[f][1])

    def read(self, start):
        end = {"files": {f: [m, s] for f, m, s in listing(self.root) if m is not None}}
        return iter(list(self._between(start, end))), end

    def readBetweenOffsets(self, start, end):
        return iter(list(self._between(start, end)))

    def commit(self, end):
        return None


class VaultSource(DataSource):
    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return CHANGES if self.options.get("changes") == "true" else SCHEMA

    def reader(self, schema):
        return VaultReader(self.options)

    def simpleStreamReader(self, schema):
        return VaultChanges(self.options)


def read_vault(spark, path: str, hidden: bool = False):
    from folioframe.shipping import ship

    ship(spark).dataSource.register(VaultSource)
    return spark.read.format("vault").option("hidden", str(hidden).lower()).load(path)


def vault_changes(spark, path: str):
    from folioframe.shipping import ship

    ship(spark).dataSource.register(VaultSource)
    return spark.readStream.format("vault").option("changes", "true").load(path)
