"""The vault's public queries: search, links, outline, fragment, metadata, tree, info."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.errors import VaultError
from folioframe.functions import scalars
from folioframe.operators import fulltext, fuzzy, links, snippets, tree
from folioframe.plans import filters, paging
from folioframe.sources.index import VaultIndex

ALGORITHMS = {"search": "bm25-porter", "snippet": "bm25-fragment-v1", "preview": "filter-preview-v1", "fuzzy": "stable-id-fuzzy-v1", "sanitize": "query-sanitize-v1"}


class Vault:
    """Queries over an index; each returns a DataFrame, and pages carry a cursor."""

    def __init__(self, index: VaultIndex) -> None:
        self.index = index

    def _ready(self) -> None:
        if not self.index.manifest["folder"]:
            raise VaultError("INDEX_WARMING", "the index isn't built yet")

    def _known(self, file: str) -> None:
        self._ready()
        if not self.index.table("frontmatter").where(F.col("file") == file).take(1):
            raise VaultError("PATH_NOT_FOUND", f"no such file: {file}")

    def search(self, query: str = "", filter_tree: dict | None = None, scope: tuple[str, str] = ("vault", ""), page_size: int | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """A page of fragments and the next page's cursor.

        With a query, by score; with a filter alone, by file; with neither, nothing.
        """
        predicate = filters.compile_filter(filter_tree)
        phrases = fulltext.sanitize(query)
        self._ready()
        frags = self.index.fragments()
        path = F.coalesce(F.to_json("heading_path"), F.lit("")).alias("path")
        if phrases:
            rows = self.index.postings().search(query).join(frags, "frag_id")
        else:
            rows = frags.withColumn("score", F.lit(0.0)).where(F.lit(predicate is not None))
        rows = rows.where(filters.scope(*scope))
        if predicate is not None:
            meta = self.index.table("frontmatter").where(predicate).select("file")
            rows = rows.join(meta, "file", "left_semi")
        rows = rows.select("file", path, "anchor_kind", "pos", "stable_id", "heading_text", F.round("score", 9).alias("score"), "body", "code")
        order = [(F.col("score"), True)] * bool(phrases) + [(F.col(c), False) for c in ("file", "path", "anchor_kind", "pos")]
        request = paging.request_hash(filters.filter_hash(filter_tree), *scope, query)
        sort, snapshot = "score" if phrases else "file", self.index.manifest["snapshot"]
        last = paging.decode(cursor, sort, request, snapshot)["last"] if cursor else None
        found = paging.page(rows, order, page_size, last)
        items = found.collect()  # a page: MAX_PAGE rows at most
        following = None
        if len(items) == paging.clamp(page_size):
            names = ["score"] * bool(phrases) + ["file", "path", "anchor_kind", "pos"]
            following = paging.encode({"sort": sort, "request_hash": request, "snapshot": snapshot, "last": [items[-1][n] for n in names]})
        page = self.index.spark.createDataFrame(items, found.schema)
        return (snippets.with_snippets(page, query).drop("body", "code"), following)

    def resolved_links(self) -> DataFrame:
        self._ready()
        rows = self.index.table("links").withColumn("link_id", F.concat_ws("#", "source_file", F.col("pos").cast("string")))
        return links.resolve(links.parse_target(rows), self.index.table("frontmatter").select("file"))

    def get_links(self, file: str, direction: str = "both", stable_id: str | None = None) -> DataFrame:
        """Incoming links by source file and place, then outgoing ones by place, targets resolved."""
        return self._links(file, direction, stable_id).orderBy("phase", "source_file", "pos")

    def get_links_page(self, file: str, direction: str = "both", stable_id: str | None = None, page_size: int | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """A page of ``get_links`` and the next page's cursor."""
        rows = self._links(file, direction, stable_id)
        return self._page(rows, ["phase", "source_file", "pos"], paging.request_hash("links", file, direction, stable_id), page_size, cursor)

    def _page(self, rows: DataFrame, names: list[str], request: str, page_size: int | None, cursor: str | None) -> tuple[DataFrame, str | None]:
        """A page in the order of ``names``, which tell all rows apart; the cursor if more follow."""
        snapshot, size = self.index.manifest["snapshot"], paging.clamp(page_size)
        last = paging.decode(cursor, names[0], request, snapshot)["last"] if cursor else None
        order = [(F.col(n), False) for n in names]
        found = (rows if last is None else rows.where(paging.after(order, last))).orderBy(*names).limit(size + 1)
        items = found.collect()  # a page and one row: MAX_PAGE + 1 at most
        following = None
        if len(items) > size:
            items = items[:size]
            following = paging.encode({"sort": names[0], "request_hash": request, "snapshot": snapshot, "last": [items[-1][n] for n in names]})
        return self.index.spark.createDataFrame(items, found.schema), following

    def _links(self, file: str, direction: str, stable_id: str | None) -> DataFrame:
        self._known(file)
        found = self.resolved_links()
        heads = self.index.table("fragments").where("anchor_kind = 'heading'").select("file", "heading_text", "heading_path", "stable_id", "pos")
        found = links.resolve_headings(found, heads).withColumn("embed_kind", F.when(F.col("is_embed"), links.embed_kind()))
        found = links.resolve_blocks(found, self.index.table("blocks"))
        incoming = links.backlinks(found, file)
        if stable_id:
            incoming = incoming.where(F.coalesce("target_stable_id", "block_stable_id") == stable_id)
        incoming = incoming.withColumn("phase", F.lit(0))
        outgoing = found.where(F.col("source_file") == file).withColumn("phase", F.lit(1))
        return {"in": incoming, "out": outgoing}.get(direction) if direction != "both" else incoming.unionByName(outgoing)

    def get_file_outline(self, file: str) -> DataFrame:
        self._known(file)
        rows = self.index.table("fragments").where((F.col("file") == file) & (F.col("anchor_kind") == "heading"))
        return rows.select("pos", "level", "heading_text", "slug", "stable_id", "structural_path", "tokens", "kinds").orderBy("pos")

    def get_fragment(self, file: str, stable_id: str | None = None, heading_path: list[str] | None = None, block: str | None = None) -> DataFrame:
        """The fragment of an id, a heading path or a block; without one, the whole file's rows.

        A retired id is answered by its best candidates instead.
        """
        self._known(file)
        rows = self.index.table("fragments").where(F.col("file") == file)
        if stable_id:
            fresh = rows.where(F.col("stable_id") == stable_id)
            if fresh.take(1):
                return fresh
            stale = self.index.history().where((F.col("file") == file) & (F.col("stable_id") == stable_id))
            if not stale.take(1):
                raise VaultError("FRAGMENT_NOT_FOUND", stable_id)
            best = fuzzy.recover(stale, rows.where("stable_id is not null"))
            return rows.join(best.select("stable_id", "score", "rank"), "stable_id").orderBy("rank")
        if heading_path:
            return rows.where(F.col("heading_path") == F.array(*map(F.lit, heading_path)))
        if block:
            place = self.index.table("blocks").where((F.col("file") == file) & (F.col("block_id") == block))
            return place
        return rows.orderBy("pos")

    def get_metadata(self, file: str) -> DataFrame:
        self._known(file)
        return self.index.table("frontmatter").where(F.col("file") == file).select("file", "fields", "tags", "created", "updated")

    def get_vault_tree(self, path: str = "", depth: int = 2) -> DataFrame:
        """Directories first, to a depth below ``path``, with counts of children and headings."""
        return self._tree(path, depth).orderBy("dfs_rank")

    def get_vault_tree_page(self, path: str = "", depth: int = 2, page_size: int | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """A page of ``get_vault_tree`` and the next page's cursor."""
        return self._page(self._tree(path, depth), ["dfs_rank"], paging.request_hash("tree", path, depth), page_size, cursor)

    def _tree(self, path: str, depth: int) -> DataFrame:
        self._ready()
        files = self.index.table("files").select("file")
        files = files.where(filters.scope("subtree", path)) if path else files
        base = len([p for p in path.split("/") if p])
        rows = tree.ranked(files).where((F.col("depth") > base) & (F.col("depth") <= base + depth + 1))
        kids = tree.children(files).select(F.col("parent").alias("path"), "n_children")
        stats = self.index.table("metrics").select(F.col("file").alias("path"), "n_headings", "tokens")
        return rows.join(kids, "path", "left").join(stats, "path", "left").withColumn("id", tree.tree_id(F.col("path")))

    def get_server_info(self) -> dict:
        m = self.index.manifest
        return {"state": m["state"], "snapshot": m["snapshot"], "files": self.index.table("frontmatter").count() if m["folder"] else 0, "algorithms": ALGORITHMS}

    def read_note(self, file: str) -> str:
        """The text of a file, straight from the vault."""
        from folioframe.sources.vault import read_vault

        reason = self.index.spark.createDataFrame([(file,)], "file string").select(scalars.path_policy(F.col("file"))).first()[0]
        if reason:
            raise VaultError("PATH_REJECTED", reason)
        row = read_vault(self.index.spark, self.index.vault, self.index.hidden).where(F.col("file") == file).first()
        if row is None:
            raise VaultError("PATH_NOT_FOUND", file)
        return bytes(row["content"]).decode("utf-8-sig")


def one_line(text: str) -> str:
    """White space collapsed and control characters escaped, for prose output."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m.group()):02x}", re.sub(r"\s+", " ", text).strip())


def prose(rows: list, title: str) -> str:
    """Result rows as readable lines."""
    out = [title]
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else dict(r)
        out.append("- " + "; ".join(f"{k}: {one_line(str(v))}" for k, v in d.items() if v is not None))
    return "\n".join(out)
