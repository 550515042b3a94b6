"""Markdown: a line-based reader of the blocks that matter here.

Headings (ATX and setext) count only at top level: not in lists, quotes, code or HTML.
Recognised besides: front matter, fences, indented code, tables, lists, quotes and
callouts, math blocks, inline code and math, images, block ids.
"""

from __future__ import annotations

import re

from . import yaml12
from .model import Heading, ParseError, Parsed, complete, heading_text

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
LIST = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
HTML = re.compile(r" {0,3}<(?:[A-Za-z][A-Za-z0-9-]*|/[A-Za-z]|!--|\?|!)")
TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
INLINE_MATH = re.compile(r"(?<![\\$])\$(?!\s|\$)([^$\n]+?)(?<![\s\\])\$(?!\d|\$)")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
BLOCK_ID = re.compile(r"(?:^|\s)\^([a-zA-Z0-9-]+)\s*$")
INLINE = (
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"(`+)(.+?)\1"), r"\2"),
    (re.compile(r"(\*\*|__|~~)(.+?)\1"), r"\2"),
    (re.compile(r"(?<!\w)([*_])(?!\s)(.+?)(?<!\s)\1(?!\w)"), r"\2"),
    (re.compile(r"<[^>]+>"), ""),
    (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"),
)


def display(text: str) -> str:
    for pattern, new in INLINE:
        text = pattern.sub(new, text)
    return heading_text(text)


def front_matter(source: str) -> tuple[dict, int]:
    """The metadata and where the body begins."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", source, re.S)
    if not m:
        return {}, 0
    data = yaml12.load(m.group(1))
    if data is not None and not isinstance(data, dict):
        raise ParseError("syntax", "front matter must be a mapping")
    return data or {}, m.end()


def parse(source: str, path: str) -> Parsed:
    source = source.removeprefix("﻿")
    meta, at = front_matter(source)
    out = Parsed("markdown", source, meta, at)
    lines: list[tuple[int, str]] = []
    for line in source[at:].splitlines(keepends=True):
        lines.append((at, line.rstrip("\r\n")))
        at += len(line)
    kinds: list[tuple[int, str]] = []
    para: list[tuple[int, str]] = []
    last_block: tuple[int, int] | None = None
    i, in_list = 0, False

    def close() -> None:
        nonlocal para, last_block
        if not para:
            return
        start, end = para[0][0], para[-1][0] + len(para[-1][1])
        text = source[start:end]
        code: list[tuple[int, int]] = []
        for pattern in (INLINE_CODE, INLINE_MATH):
            for m in pattern.finditer(text):
                span = (start + m.start(), start + m.end())
                if not any(a < span[1] and span[0] < b for a, b in code):
                    code.append(span)
                    if pattern is INLINE_MATH:
                        kinds.append((span[0], "math"))
        out.excluded.extend(code)
        if any(not any(a <= start + m.start() < b for a, b in code) for m in IMAGE.finditer(text)):
            kinds.append((start, "image"))
        only = re.fullmatch(r"\s*\^([a-zA-Z0-9-]+)\s*", text)
        m = BLOCK_ID.search(text)
        if only and last_block:  # stands alone: names the block before it
            out.blocks.append((only.group(1), *last_block))
        elif m and not any(a <= start + m.start(1) < b for a, b in code):
            out.blocks.append((m.group(1), start, end))
        last_block = (start, end)
        para = []

    while i < len(lines):
        off, line = lines[i]
        fence = FENCE.match(line)
        blank = not line.strip()
        indented = line.startswith(("    ", "\t"))
        if blank:
            close()
            i += 1
            continue
        if fence and not (in_list and indented):
            close()
            mark = fence.group(1)
            j = i + 1
            while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j][1]):
                j += 1
            end = lines[min(j, len(lines) - 1)]
            span = (off, end[0] + len(end[1]))
            out.excluded.append(span)
            kinds.append((off, "code"))
            last_block = span
            i, in_list = j + 1, False
            continue
        if line.lstrip().startswith("$$") and not indented:
            close()
            j = i if line.strip().endswith("$$") and len(line.strip()) > 3 else i + 1
            while j < len(lines) and j != i and "$$" not in lines[j][1]:
                j += 1
            end = lines[min(j, len(lines) - 1)]
            out.excluded.append((off, end[0] + len(end[1])))
            kinds.append((off, "math"))
            last_block = out.excluded[-1]
            i = j + 1
            continue
        if indented and not para and not in_list:
            j = i
            while j < len(lines) and (lines[j][1].startswith(("    ", "\t")) or not lines[j][1].strip()):
                j += 1
            while not lines[j - 1][1].strip():
                j -= 1
            out.excluded.append((off, lines[j - 1][0] + len(lines[j - 1][1])))
            kinds.append((off, "code"))
            last_block = out.excluded[-1]
            i = j
            continue
        if re.match(r" {0,3}>", line):
            close()
            kinds += [(off, "callout")] if re.match(r" {0,3}>\s*\[!\w+\]", line) else []
            j = i
            while j < len(lines) and lines[j][1].strip() and (re.match(r" {0,3}>", lines[j][1]) or not (ATX.match(lines[j][1]) or FENCE.match(lines[j][1]) or LIST.match(lines[j][1]))):
                j += 1
            para = lines[i:j]
            close()
            i, in_list = j, False
            continue
        if LIST.match(line) and not BREAK.match(line) and not (para and re.match(r" {0,3}\d", line) and not re.match(r" {0,3}1[.)]", line)):
            close()
            kinds.append((off, "list"))
            in_list, para = True, [(off, line)]
            i += 1
            while i < len(lines) and lines[i][1].strip() and not LIST.match(lines[i][1].strip()) and (lines[i][1].startswith((" ", "\t")) or not (ATX.match(lines[i][1]) or FENCE.match(lines[i][1]))):
                para.append(lines[i])
                i += 1
            close()
            continue
        if in_list and line.startswith((" ", "\t")):
            if line.strip().startswith(("-", "*", "+")) or fence or para:
                kinds.append((off, "list")) if not fence else None
            para.append((off, line))
            i += 1
            if i >= len(lines) or LIST.match(lines[i][1].strip()):
                close()
            continue
        in_list = False
        atx = ATX.match(line)
        if atx and not indented:
            close()
            text = display(atx.group(2) or "")
            out.headings.append(Heading(len(atx.group(1)), text, off, off + len(line) + 1))
            last_block = (off, off + len(line))
            m = BLOCK_ID.search(line)
            if m:
                out.blocks.append((m.group(1), off, off + len(line)))
            i += 1
            continue
        under = SETEXT.match(line)
        if para and under and not BLOCK_ID.fullmatch(line):
            level = 1 if under.group(1)[0] == "=" else 2
            start = para[0][0]
            text = display(" ".join(x for _, x in para))
            para = []
            out.headings.append(Heading(level, text, start, off + len(line) + 1))
            last_block = (start, off + len(line))
            i += 1
            continue
        if BREAK.match(line):
            close()
            i += 1
            continue
        if HTML.match(line) and not para:
            j = i
            while j < len(lines) and lines[j][1].strip():
                j += 1
            last_block = (off, lines[j - 1][0] + len(lines[j - 1][1]))
            i = j
            continue
        if para and TABLE.match(line) and "|" in para[-1][1] and ("|" in line):
            kinds.append((para[-1][0], "table"))
        para.append((off, line))
        i += 1
    close()
    out.excluded.sort()
    out.headings.sort(key=lambda h: h.start)
    complete(out, path)
    seen: dict[str, tuple[str, int, int]] = {}
    for b in out.blocks:
        seen.setdefault(b[0], b)
    out.blocks = list(seen.values())
    for pos, kind in sorted(kinds):
        owner = next((h.kinds for h in reversed(out.headings) if h.start <= pos), out.preamble_kinds)
        if kind not in owner:
            owner.append(kind)
    for h in out.headings:
        h.body_start = min(h.body_start, len(source))
    return out
