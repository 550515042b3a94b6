"""Builds sections from structured files (specifications, schemas) as Markdown-like text."""

from __future__ import annotations

import json

from .model import Heading, Parsed, complete, sha14

FENCE_LIMIT = 64 * 1024


class Builder:
    def __init__(self, kind: str, frontmatter: dict) -> None:
        self.kind, self.meta, self.parts, self.size = kind, frontmatter, [], 0
        self.headings: list[Heading] = []
        self.fences: list[tuple[int, int]] = []

    def add(self, text: str) -> Builder:
        self.parts.append(text)
        self.size += len(text)
        return self

    def section(self, level: int, text: str, slot: str = "") -> Builder:
        start = self.size
        self.add(f"{'#' * level} {text}\n\n")
        self.headings.append(Heading(level, text, start, self.size, slot))
        return self

    def line(self, label: str, value) -> Builder:
        return self.add(f"{label}: {value}\n\n") if value not in (None, "", [], {}) else self

    def fence(self, value) -> Builder:
        if value in (None, {}, []):
            return self
        text = json.dumps(value, indent=2, ensure_ascii=False)
        kind = "json" if len(text) <= FENCE_LIMIT else "text"
        start = self.size
        self.add(f"```{kind}\n{text[:FENCE_LIMIT]}\n```\n\n")
        self.fences.append((start, self.size - 2))
        if self.headings and "code" not in self.headings[-1].kinds:
            self.headings[-1].kinds.append("code")
        return self

    def done(self, path: str) -> Parsed:
        return complete(Parsed(self.kind, "".join(self.parts), self.meta, 0, self.headings, self.fences), path)


def slot(kind: str, name: str) -> str:
    return f"{kind}[{sha14(name)}]"


def as_dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def as_list(value) -> list:
    return value if isinstance(value, list) else []


def pointer(root: dict, ref: str):
    """What a local JSON pointer names, one level; None for others."""
    from urllib.parse import unquote

    if not ref.startswith("#/"):
        return None
    node = root
    for part in ref[2:].split("/"):
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        node = node.get(part) if isinstance(node, dict) else None
    return node


def merged(base, over):
    """``over`` onto ``base``: mappings merge, everything else and references replace."""
    if isinstance(base, dict) and isinstance(over, dict) and "$ref" not in base and "$ref" not in over:
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in over.items()}}
    return over
