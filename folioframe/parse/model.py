"""What every parser returns: headings, blocks, links, and the rows made of them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass, field

MAX_BYTES = 10 * 1024 * 1024


class ParseError(ValueError):
    """A file that can't be parsed; ``reason`` says why."""

    def __init__(self, reason: str, message: str = "") -> None:
        super().__init__(message or reason)
        self.reason = reason


@dataclass
class Heading:
    level: int
    text: str
    start: int
    body_start: int
    slot: str = ""  # set by parsers whose sections have names of their own
    kinds: list[str] = field(default_factory=list)
    stable_id: str = ""
    structural_path: str = ""
    path: list[str] = field(default_factory=list)
    slug: str = ""
    body_end: int = 0
    end: int = 0


@dataclass
class Parsed:
    kind: str
    source: str
    frontmatter: dict = field(default_factory=dict)
    body_start: int = 0
    headings: list[Heading] = field(default_factory=list)
    excluded: list[tuple[int, int]] = field(default_factory=list)
    blocks: list[tuple[str, int, int]] = field(default_factory=list)
    preamble_kinds: list[str] = field(default_factory=list)


def heading_text(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).strip())


def slug(text: str) -> str:
    text = re.sub(r"[^\w\s-]", "", text.strip().lower())
    return re.sub(r"\s", "-", text)


def sha14(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:14]


def complete(parsed: Parsed, path: str) -> Parsed:
    """Structural paths, ids, section ends, heading paths and slugs of the headings."""
    open_: list[Heading] = []
    places: dict[tuple[str, int], int] = {}
    slugs: dict[str, int] = {}
    hs, n = parsed.headings, len(parsed.source)
    for i, h in enumerate(hs):
        while open_ and open_[-1].level >= h.level:
            open_.pop()
        parent = open_[-1] if open_ else None
        base = parent.structural_path if parent else ""
        k = places.get((base, h.level), 0)
        places[base, h.level] = k + 1
        h.structural_path = "/".join(filter(None, (base, h.slot or f"h{h.level}[{k}]")))
        h.stable_id = "h:" + sha14(f"{path}:{h.structural_path}")
        h.path = [*(parent.path if parent else []), h.text]
        s = slug(h.text)
        slugs[s] = slugs.get(s, -1) + 1
        h.slug = s if not slugs[s] else f"{s}-{slugs[s]}"
        h.body_end = hs[i + 1].start if i + 1 < len(hs) else n
        h.end = next((x.start for x in hs[i + 1 :] if x.level <= h.level), n)
        open_.append(h)
    return parsed


def estimate_tokens(text: str) -> int:
    """The same heuristic as ``functions.scalars.estimate_tokens``."""
    if not re.search(r"[^\x00-\x20]", text):
        return 0
    n = len(text)
    fenced = sum(len(m.group()) for m in re.finditer(r"(?s)```.*?(?:```|\Z)", text))
    cjk = len(re.findall(r"[぀-ヿ㐀-䶿一-鿿가-힯]", text))
    per = 2.7 if fenced > n * 0.3 else 1.5 if cjk > n * 0.3 else 3.5
    return max(1, int(n / per + 0.5))


LINK = re.compile(r"(!)?\[\[([^\]\n]+)\]\]")


def wikilinks(source: str, start: int, end: int, excluded: list[tuple[int, int]]) -> list[dict]:
    """Links of a span: not escaped, not inside code or math."""
    out = []
    for m in LINK.finditer(source, start, end):
        if any(a <= m.start() < b for a, b in excluded):
            continue
        slashes = len(source[: m.start()]) - len(source[: m.start()].rstrip("\\"))
        if slashes % 2:
            continue
        target, _, alias = m.group(2).partition("|")
        target = re.sub(r"\s*#\s*", "#", unicodedata.normalize("NFC", target.strip()))
        lead = "./" if target.startswith("./") else ""
        target = re.sub(r"(?<![^/])\./", "", target)
        target = target if target.startswith("../") else lead + target
        out.append({"raw_target": target, "lc_raw_target": target.lower(), "is_embed": bool(m.group(1)), "alias": alias.strip() or None, "link_text": m.group()})
    return out


def split_text(source: str, start: int, end: int, excluded: list[tuple[int, int]]) -> tuple[str, str]:
    """Body text without code and math, and the code and math."""
    body, code, at = [], [], start
    for a, b in sorted(excluded):
        if b > at and a < end:
            body.append(source[at : max(at, a)])
            code.append(source[max(a, start) : min(b, end)] + "\n")
            at = max(at, b)
    body.append(source[at:end])
    return "".join(body), "".join(code)
