"""Keyset pages: cursors, ordering and the predicate that continues after a row."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.errors import cursor_error

DEFAULT_PAGE, MAX_PAGE = 50, 200


def clamp(size: int | None) -> int:
    return DEFAULT_PAGE if size is None else max(1, min(MAX_PAGE, int(size)))


def encode(cursor: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(cursor, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(raw: str, sort: str, request: str, snapshot: int) -> dict:
    """The cursor, if it belongs to this sort, request and snapshot."""
    try:
        got = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError as e:
        raise cursor_error("the cursor can't be read") from e
    if not isinstance(got, dict) or (got.get("sort"), got.get("request_hash"), got.get("snapshot")) != (sort, request, snapshot):
        raise cursor_error("the cursor belongs to another request or snapshot")
    return got


def request_hash(*parts: object) -> str:
    return hashlib.sha1("\x00".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def after(columns: Sequence[tuple[Column, bool]], last: Sequence) -> Column:
    """Rows behind ``last`` in the order of (column, descending) pairs."""
    out, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(columns, last):
        out = out | (same & ((c < F.lit(v)) if down else (c > F.lit(v))))
        same = same & (c == F.lit(v))
    return out


def page(df: DataFrame, columns: Sequence[tuple[Column, bool]], size: int | None = None, last: Sequence | None = None) -> DataFrame:
    """One page; ordering and limit become a top-k without a full sort."""
    rows = df if last is None else df.where(after(columns, last))
    return rows.orderBy(*[c.desc() if down else c.asc() for c, down in columns]).limit(clamp(size))
