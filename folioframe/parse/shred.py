"""Parsed files to rows of the vault's tables, in parallel by file."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import dates
from folioframe.shipping import ship

from . import markdown, prisma, specs
from .model import MAX_BYTES, ParseError, Parsed, estimate_tokens, split_text, wikilinks

TAG = re.compile(r"[a-zA-Z0-9_/-]+\Z")
PARSERS = {"md": markdown.parse, "markdown": markdown.parse, "yaml": specs.parse, "yml": specs.parse, "prisma": prisma.parse}
FRAGMENT = (
    "file string, anchor_kind string, stable_id string, heading_path array<string>, heading_text string, structural_path string, level int, slug string,"
    " range_start int, range_end int, body string, code string, headings string, tokens long, kinds array<string>, pos int"
)
LINK = "source_file string, source_anchor_kind string, source_stable_id string, link_ordinal int, raw_target string, lc_raw_target string, is_embed boolean, alias string, link_text string, pos int"
SCHEMA = (
    f"file string, kind string, error string, fields string, tags array<string>, created string, updated string, mtime double, size long,"
    f" fragments array<struct<{FRAGMENT.replace(' string', ':string').replace(' int', ':int').replace(' long', ':bigint').replace(' array', ':array')}>>,"
    f" links array<struct<{LINK.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>,"
    " blocks array<struct<block_id:string,range_start:int,range_end:int,stable_id:string>>"
)


def tags_of(meta: dict) -> list[str]:
    found: dict[str, None] = {}
    for key in ("tags", "tag"):
        value = meta.get(key)
        for item in value if isinstance(value, list) else [value]:
            for t in re.split(r"[\s,]+", item) if isinstance(item, str) else ():
                t = t.lstrip("#")
                if TAG.match(t):
                    found.setdefault(t.lower())
    return list(found)


def canonical_dates(value):
    if isinstance(value, dict):
        return {k: canonical_dates(v) for k, v in value.items()}
    if isinstance(value, list):
        return [canonical_dates(v) for v in value]
    return (dates.canonical(value) or value) if isinstance(value, str) else value


def rows_of(parsed: Parsed, file: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Fragments, links and blocks: headings, then the preamble; or one row for the file."""
    stem = re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])
    frags, found = [], []
    src, hs = parsed.source, parsed.headings
    spans = [(h, h.start, h.body_end) for h in hs]
    first = hs[0].start if hs else len(src)
    preamble = src[parsed.body_start : first]
    for h in hs:
        body, code = split_text(src, h.body_start, h.body_end, parsed.excluded)
        frags.append({"anchor_kind": "heading", "stable_id": h.stable_id, "heading_path": h.path, "heading_text": h.text, "structural_path": h.structural_path, "level": h.level, "slug": h.slug, "range_start": h.start, "range_end": h.end, "body": body, "code": code, "headings": " ".join(h.path), "tokens": estimate_tokens(src[h.body_start : h.body_end]), "kinds": h.kinds})
    if not hs or preamble.strip():
        body, code = split_text(src, parsed.body_start, first, parsed.excluded)
        frags.append({"anchor_kind": "preamble" if hs else "file", "stable_id": None, "heading_path": None, "heading_text": None, "structural_path": None, "level": None, "slug": None, "range_start": parsed.body_start, "range_end": first, "body": body, "code": code, "headings": stem, "tokens": estimate_tokens(preamble), "kinds": parsed.preamble_kinds})
    if parsed.kind == "markdown":
        for h, a, b in [(None, parsed.body_start, first), *spans]:
            for n, link in enumerate(wikilinks(src, a, b, parsed.excluded), 1):
                found.append({"source_anchor_kind": "heading" if h else "preamble" if hs else "file", "source_stable_id": h.stable_id if h else None, "link_ordinal": n, **link})
    for rows, key in ((frags, "file"), (found, "source_file")):
        for i, r in enumerate(rows):
            r |= {key: file, "pos": i}
    blocks = []
    for name, a, b in parsed.blocks:
        owner = next((h for h in reversed(hs) if h.start <= a < h.end), None)
        blocks.append({"block_id": name, "range_start": a, "range_end": b, "stable_id": owner.stable_id if owner else None})
    return frags, found, blocks


def shred_one(file: str, content: bytes | None, mtime: float | None, size: int | None = None, error: str | None = None) -> dict:
    """A file's row; one that its reader couldn't give has the reader's error and size."""
    out = {"file": file, "kind": None, "error": error, "fields": "{}", "tags": [], "created": None, "updated": None, "mtime": mtime, "size": len(content or b"") if size is None else size, "fragments": [], "links": [], "blocks": []}
    if error is not None:
        return out
    try:
        if content is not None and len(content) > MAX_BYTES:
            raise ParseError("too_large")
        parse = PARSERS.get(file.rsplit(".", 1)[-1].lower())
        if parse is None:
            raise ParseError("unsupported")
        parsed = parse((content or b"").decode("utf-8-sig"), file)
        meta = canonical_dates(parsed.frontmatter)
        out |= dict(zip(("fragments", "links", "blocks"), rows_of(parsed, file)))
        out |= {"kind": parsed.kind, "fields": json.dumps(meta, ensure_ascii=False), "tags": tags_of(meta)}
        for key in ("created", "updated"):
            value = meta.get(key)
            out[key] = dates.canonical(value) if isinstance(value, str) else None
    except ParseError as e:
        out["error"] = e.reason
    except UnicodeDecodeError:
        out["error"] = "not_utf8"
    return out


def shred(files: DataFrame) -> DataFrame:
    """One row for each file (file, content binary, mtime), with its tables nested.

    A file that can't be parsed has an ``error`` and no rows. Files are independent, so
    this is a map over partitions without a shuffle.
    """
    ship(files.sparkSession)

    extra = [c for c in ("size", "error") if c in files.columns]  # as the vault's reader gives them

    def run(batches):
        for pdf in batches:
            none = [None] * len(pdf)
            size = [None if pd.isna(x) else int(x) for x in pdf["size"]] if "size" in extra else none
            error = [x if isinstance(x, str) else None for x in pdf["error"]] if "error" in extra else none
            rows = zip(pdf["file"], pdf["content"], pdf["mtime"], size, error)
            yield pd.DataFrame([shred_one(f, bytes(c) if c is not None else None, m, n, e) for f, c, m, n, e in rows], columns=["file", "kind", "error", "fields", "tags", "created", "updated", "mtime", "size", "fragments", "links", "blocks"])

    return files.select("file", "content", "mtime", *extra).mapInPandas(run, SCHEMA)


def tables(shredded: DataFrame) -> dict[str, DataFrame]:
    """The vault's tables from shredded files; rows with an error are kept in ``files`` only."""
    good = shredded.where("error is null")
    frag = good.select(F.inline("fragments"))
    metrics = frag.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("content_kinds"), F.count_if(F.col("anchor_kind") == "heading").alias("n_headings"))
    return {
        "files": shredded.select("file", "kind", "error", "mtime", "size"),
        "frontmatter": good.select("file", "fields", "tags", "created", "updated", "mtime", "size"),
        "tags": good.select("file", F.explode("tags").alias("tag")),
        "fragments": frag,
        "links": good.select(F.inline("links")),
        "blocks": good.select("file", F.inline("blocks")),
        "metrics": metrics,
    }
