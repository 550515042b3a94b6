"""ISO dates on the request side."""

from __future__ import annotations

import re
from datetime import UTC, datetime

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?\Z")


def is_date(s: str) -> bool:
    try:
        return bool(_DATE.match(s)) and bool(datetime.strptime(s, "%Y-%m-%d"))
    except ValueError:
        return False


def canonical(s: str) -> str | None:
    """A date or time as ``YYYY-MM-DDTHH:MM:SSZ``; a time without a zone is UTC."""
    s = s.strip()
    if is_date(s):
        return f"{s}T00:00:00Z"
    if not _TIME.match(s):
        return None
    try:
        t = datetime.fromisoformat(s.replace("z", "Z").replace(" ", "T", 1))
    except ValueError:
        return None
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def bound(s: str, op: str) -> str | None:
    """A bound of a range: whole days end with their last second for ``lte`` and ``gt``."""
    if is_date(s.strip()):
        return f"{s.strip()}T{'00:00:00' if op in ('gte', 'lt') else '23:59:59'}Z"
    return canonical(s)
