"""Prisma schemas: a section for each block, with its documentation and fields."""

from __future__ import annotations

import re
from collections import Counter

from .model import Parsed, complete
from .synth import Builder, slot

#: The kinds of blocks.
KINDS = ("model", "enum", "view", "type", "datasource", "generator")
OPEN = re.compile(rf"^\s*({'|'.join(KINDS)})\s+(\w+)\s*\{{(.*)$")
STRING = re.compile(r'"(?:\\.|[^"\\])*"')


def strip_comments(source: str) -> tuple[str, list[str]]:
    """``/* */`` comments blanked out in place, and their texts."""
    notes: list[str] = []

    def blank(m: re.Match) -> str:
        if not m.group().startswith("/*"):
            return m.group()
        notes.append(m.group()[2:-2].strip() if m.group().endswith("*/") else m.group()[2:].strip())
        return re.sub(r"[^\n]", " ", m.group())

    return re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', blank, source, flags=re.S), notes


def _code(line: str) -> str:
    """A line without its ``//`` comment; slashes in strings stay."""
    masked = STRING.sub(lambda m: "x" * len(m.group()), line)
    at = masked.find("//")
    return (line if at < 0 else line[:at]).strip()


def blocks(source: str) -> list[dict]:
    out, docs, now = [], [], None
    for line in source.split("\n"):
        text = line.strip()
        if text.startswith("///"):
            docs.append(text[3:].strip())
            continue
        if text.startswith("//"):
            continue
        m = OPEN.match(line) if now is None else None
        if m:
            now = {"kind": m.group(1), "name": m.group(2), "docs": docs, "fields": [], "attributes": []}
            docs = []
            text = m.group(3).strip()
        code = _code(text)
        if now is None:
            if code:
                docs = []
            continue
        closes = code.endswith("}") and code.count("}") > code.count("{")
        code = code[:-1].strip() if closes else code
        if code.startswith("@@"):
            now["attributes"].append(code)
        elif code:
            now["fields"].append((code, docs))
        if code:
            docs = []
        if closes:
            out.append(now)
            now, docs = None, []
    return out


def _settings(block: dict) -> dict:
    pairs = (re.match(r"(\w+)\s*=\s*(.+)$", code) for code, _ in block["fields"])
    return {"name": block["name"], **{m.group(1): m.group(2).strip().strip('"') for m in pairs if m}}


def parse(source: str, path: str) -> Parsed:
    plain, notes = strip_comments(source)
    found = blocks(plain)
    if not found and not notes:
        return complete(Parsed("prisma", source), path)
    meta = {k: _settings(b) for k in ("datasource", "generator") for b in found if b["kind"] == k}
    out = Builder("prisma", meta)
    seen: Counter = Counter()
    for b in found:
        key = slot(b["kind"], b["name"])
        seen[key] += 1
        out.section(1, f"{b['kind']} {b['name']}", key if seen[key] == 1 else f"{key}#{seen[key]}")
        if b["docs"]:
            out.add("\n".join(b["docs"]) + "\n\n")
        table = next((m.group(1) for a in b["attributes"] if (m := re.match(r'@@map\(\s*(?:name:\s*)?"([^"]*)"', a))), None)
        out.line("Table", table)
        for code, docs in b["fields"]:
            out.add(f"- `{code}`{' — ' + ' '.join(docs) if docs else ''}\n")
        for a in b["attributes"]:
            out.add(f"- `{a}`\n")
        out.add("\n")
    if notes:
        out.section(1, "Schema notes", "notes").add("\n\n".join(notes) + "\n")
    return out.done(path)
