"""The filter language: a tree of dicts compiled to one Column.

Rows have ``tags array<string>``, ``fields`` (JSON text), ``created``, ``updated`` (ISO
text) and ``mtime`` (ms). Values in ``fields`` keep their JSON type: a number never equals
a string. Missing and null values are NULL under three-valued logic.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.errors import filter_error
from folioframe.functions import dates
from folioframe.functions.scalars import iso_calendar_valid, ms_to_iso

TAG = re.compile(r"[a-zA-Z0-9_/-]+\Z")
RANGES = ("gte", "lte", "gt", "lt")
SCALAR_OPS = {"eq", "ne", "in", "nin", "contains", "is_empty", *RANGES}
HAS_OPS = {"has", "has_any", "has_all"}


def filter_hash(tree: dict | None) -> str:
    """SHA-1 of the tree with sorted keys; "" for none."""
    return hashlib.sha1(json.dumps(tree, sort_keys=True, separators=(",", ":")).encode()).hexdigest() if tree else ""


def path_segments(path: str) -> list[str]:
    """``a.b\\.c`` is the path a, b.c."""
    parts = [p.replace("\x00", ".") for p in path.replace("\\.", "\x00").split(".")]
    if any(not p or len(p) > 256 or not p.isprintable() for p in parts):
        raise filter_error(f"bad field path: {path!r}")
    return parts


class _Field:
    """A value inside ``fields``: its text and its JSON type, from the VARIANT column."""

    def __init__(self, path: str) -> None:
        keys = "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path_segments(path))
        self.v = F.try_variant_get(F.try_parse_json("fields"), "$" + keys, "variant")
        self.kind = F.schema_of_variant(self.v)
        self.text = self.v.try_cast("string") if hasattr(self.v, "try_cast") else self.v.cast("string")
        self.number = F.try_variant_get(self.v, "$", "double")
        self.is_number = self.kind.isin("BIGINT", "DOUBLE") | self.kind.startswith("DECIMAL") | self.kind.startswith("FLOAT")
        self.is_bool = self.kind == "BOOLEAN"
        self.null = self.v.isNull() | (self.kind == "VOID")

    def equals(self, value) -> Column:
        """NULL for a missing value; false across types (booleans are the numbers 1 and 0)."""
        if isinstance(value, bool | int | float):
            same = F.when(self.is_number, self.number == float(value)).when(self.is_bool, F.try_variant_get(self.v, "$", "boolean").cast("double") == float(value)).otherwise(False)
        else:
            iso = dates.canonical(value) if isinstance(value, str) else None
            same = F.when(self.kind == "STRING", self.text == (iso or value)).otherwise(False)
        return F.when(~self.null, same)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _list(value) -> list:
    if not isinstance(value, list | tuple):
        raise filter_error("a list is needed")
    return list(value)


def _tag(value: str) -> Column:
    if not isinstance(value, str) or not TAG.match(value):
        raise filter_error(f"bad tag: {value!r}")
    v = value.lower()
    return F.exists("tags", lambda t: (t == v) | t.startswith(v + "/"))


def _tags(ops: dict) -> Column:
    out = []
    for op, value in ops.items():
        if op == "has":
            out.append(_tag(value))
        elif op in HAS_OPS:
            out.append((_any if op == "has_any" else _all)([_tag(v) for v in _list(value)]))
        else:
            raise filter_error(f"unknown tag operator {op}")
    return _all(out)


def _compare(e: Column, op: str, value) -> Column:
    return {"gte": e >= value, "lte": e <= value, "gt": e > value, "lt": e < value}[op]


def _date(ops: dict) -> Column:
    own = F.get_json_object("fields", "$['date']")
    e = F.coalesce(iso_calendar_valid(own), F.col("updated"), F.col("created"), ms_to_iso(F.col("mtime")))
    out = []
    for op, value in ops.items():
        if op not in RANGES:
            raise filter_error(f"unknown date operator {op}")
        limit = dates.bound(value, op) if isinstance(value, str) else None
        if limit is None:
            raise filter_error(f"bad date: {value!r}")
        out.append(_compare(e, op, limit))
    return _all(out)


def _within(f: _Field, value) -> Column:
    """Whether a string is an element of an array, or the value itself; numbers never equal strings."""
    if not isinstance(value, str):
        raise filter_error(f"a string is needed, not {value!r}")
    iso = dates.canonical(value) or value
    items = F.try_variant_get(f.v, "$", "array<variant>")
    in_array = F.exists(items, lambda x: (F.schema_of_variant(x) == "STRING") & (x.cast("string") == iso))
    return F.when(f.kind.startswith("ARRAY"), F.coalesce(in_array, F.lit(False))).when(f.null | f.kind.startswith("OBJECT"), False).otherwise(F.coalesce(f.equals(value), F.lit(False)))


def _field(path: str, ops: dict) -> Column:
    kinds = {"has" if op in HAS_OPS else "scalar" if op in SCALAR_OPS else "unknown" for op in ops}
    if "unknown" in kinds or len(kinds) > 1:
        raise filter_error(f"operators of field {path} are unknown or of different kinds")
    f = _Field(path)
    limits = [ops[op] for op in RANGES if op in ops]
    as_dates = bool(limits) and all(isinstance(v, str) and dates.canonical(v) for v in limits)
    out = []
    for op, value in ops.items():
        if op == "has":
            out.append(_within(f, value))
        elif op in HAS_OPS:
            out.append((_any if op == "has_any" else _all)([_within(f, v) for v in _list(value)]))
        elif op == "eq":
            out.append(f.null if value is None else f.equals(value))
        elif op == "ne":
            out.append(~f.null if value is None else ~f.equals(value))
        elif op in ("in", "nin"):
            values = _list(value)
            some = [f.equals(v) for v in values if v is not None]
            if op == "in":
                out.append(_any(some + [f.null] * (None in values)))
            else:
                none = ~_any([F.coalesce(s, F.lit(False)) for s in some]) if some else F.lit(True)
                out.append(none & ~f.null if None in values else none)
        elif op == "contains":
            out.append(F.lower(f.text).contains(str(value).lower()))
        elif op == "is_empty":
            empty = f.null | F.coalesce((f.kind == "STRING") & (f.text == ""), F.lit(False))
            out.append(empty if value else ~empty)
        elif isinstance(value, bool) or value is None:
            raise filter_error("a range needs a number or a string")
        elif isinstance(value, int | float):
            out.append(F.when(f.is_number, _compare(f.number, op, float(value))).otherwise(F.lit(False)))
        elif as_dates:
            out.append(_compare(iso_calendar_valid(f.text), op, dates.bound(value, op)))
        else:  # numbers sort before strings
            out.append(F.when(f.is_number | f.is_bool, F.lit(op in ("lt", "lte"))).when(~f.null, _compare(f.text, op, value)))
    return _all(out)


def compile_filter(tree: dict | None) -> Column | None:
    """A predicate for the tree, or None for an empty one."""
    if not tree:
        return None
    out = []
    for key, value in tree.items():
        if key == "tags":
            out.append(_tags(value))
        elif key == "date":
            out.append(_date(value))
        elif key == "fields":
            out += [_field(p, ops) for p, ops in value.items()]
        elif key in ("and", "or"):
            parts = [F.lit(True) if (c := compile_filter(t)) is None else c for t in _list(value)]
            out.append((_all if key == "and" else _any)(parts))
        elif key == "not":
            inner = compile_filter(value)
            out.append(F.lit(False) if inner is None else ~inner)
        else:
            raise filter_error(f"unknown key {key}")
    return _all(out)


def scope(kind: str, value: str = "", file: str = "file") -> Column:
    """Vault, subtree or file; a prefix test that reaches the Parquet scan."""
    if kind == "vault":
        return F.lit(True)
    if kind == "subtree":
        return F.col(file).startswith(value.rstrip("/") + "/")
    if kind == "file":
        return F.col(file) == value
    raise filter_error(f"unknown scope {kind}")
