"""Snippets of search results; for pages of results, never for a corpus."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.porter import stem
from folioframe.operators.fulltext import fold, sanitize

SHORT, HARD = 200, 220
WORD = re.compile(r"[\w-]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def preview(body: str, code: str = "", size: int = SHORT) -> str:
    """The beginning of the text, cut at a word."""
    text = (body if body.strip() else code).lstrip()
    if len(text) <= size:
        return text.rstrip()
    cut = text[:size]
    return cut[: cut.rfind(" ")] if " " in cut and not text[size].isspace() else cut.rstrip()


def snippet(body: str, code: str, exact: set[str], prefixes: tuple[str, ...]) -> str:
    """The sentence with most hits (the first of equals), its densest window, hits marked."""

    def hits(text: str) -> list[tuple[int, int]]:
        out = []
        for m in WORD.finditer(text):
            s = stem(fold(m.group().lower()))
            if s in exact or any(s.startswith(p) for p in prefixes):
                out.append(m.span())
        return out

    for text in (body, code):
        best, most = "", 0
        for m in SENTENCE.finditer(text):
            n = len(hits(m.group()))
            if n > most:
                best, most = m.group().strip(), n
        if most:
            break
    else:
        return preview(body, code)
    if len(best) > SHORT:
        spans = hits(best)
        at = max((a for a, _ in spans), key=lambda a: (sum(a <= s < a + SHORT for s, _ in spans), -a))
        at = max(0, min(at, len(best) - SHORT))
        at = best.rfind(" ", 0, at) + 1 if at else 0
        end = at + SHORT
        best = best[at : best.rfind(" ", at, end) if end < len(best) and " " in best[at:end] else end]
    out, last = [], 0
    for a, b in hits(best):
        out += [best[last:a], "**", best[a:b], "**"]
        last = b
    return ("".join(out) + best[last:])[:HARD]


def with_snippets(rows: DataFrame, query: str) -> DataFrame:
    """Adds ``snippet``; needs body and code."""
    terms = [t for p in sanitize(query) for t in ((p.terms[:-1]) if p.prefix else p.terms)]
    exact = {stem(fold(t)) for t in terms}
    prefixes = tuple(stem(fold(p.terms[-1])) for p in sanitize(query) if p.prefix)

    @F.pandas_udf("string")
    def make(body: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([snippet(b or "", c or "", exact, prefixes) for b, c in zip(body, code)])

    return rows.withColumn("snippet", make("body", "code"))
